"""Registered streaming jobs (T-1..T-3), each run to completion with availableNow."""

from __future__ import annotations

from ..sources import testdata as td
from ..streaming import incremental as ST
from . import sql_blocks as Q
from .catalog import register


@register("stream_dedup_keys", Q.with_(Q.ATT_SCALE) + " SELECT DISTINCT user_key, item, submitted_at FROM att_scale")
def stream_dedup_keys(inp):
    """T-1: streamed attempt log with duplicates of (user, item, submitted_at) dropped."""
    s = td.att_scale_from(td.stream_table(inp.spark, inp.sf_dir, "lineitem"), td.table(inp.spark, inp.sf_dir, "orders"))
    out = ST.ingest_dedup(inp.spark, s, ["user_key", "item", "submitted_at"])
    return out.select("user_key", "item", "submitted_at")


@register("stream_upsert_newest", Q.with_(Q.ATT_ORDER) + """ SELECT user_key, item, submitted_at, attempt_id, is_ac, is_wa FROM (
      SELECT *, row_number() OVER (PARTITION BY user_key, item ORDER BY submitted_at DESC, attempt_id DESC) AS rn
      FROM att_order) WHERE rn = 1""")
def stream_upsert_newest(inp):
    """T-2: foreachBatch upsert keeping the newest attempt per (user, item)."""
    s = td.att_order_from(td.stream_table(inp.spark, inp.sf_dir, "events"))
    return ST.stream_upsert_newest(inp.spark, s, ["user_key", "item"], ["is_ac", "is_wa"]).select(
        "user_key", "item", "submitted_at", "attempt_id", "is_ac", "is_wa")


@register("stream_user_tag_counts", Q.with_(Q.ATT_SCALE) + """ SELECT user_key, tag, count(*) AS total_attempts,
      CAST(sum(is_ac) AS BIGINT) AS ac_count, CAST(sum(w) AS BIGINT) AS wa_count FROM (
        SELECT user_key, is_ac, greatest(is_wa, is_tle, is_mle) AS w, unnest(tags) AS tag FROM att_scale
        WHERE (is_ac <> 0 OR greatest(is_wa, is_tle, is_mle) <> 0) AND item IS NOT NULL) GROUP BY user_key, tag""")
def stream_user_tag_counts(inp):
    """T-3: running per-(user, tag) counters from a streaming aggregate."""
    s = td.att_scale_from(td.stream_table(inp.spark, inp.sf_dir, "lineitem"), td.table(inp.spark, inp.sf_dir, "orders"))
    return ST.running_user_tag_counts(inp.spark, s, inp.items()).select(
        "user_key", "tag", "total_attempts", "ac_count", "wa_count")
