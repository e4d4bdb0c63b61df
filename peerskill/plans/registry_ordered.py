"""Registered queries: order-sensitive operators on the attempt feed (W-4..W-8, A-20, A-32..A-34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O
from . import sql_blocks as Q
from .catalog import register, rounded_select


@register(
    "dedup_newest",
    Q.with_(Q.ATT_SCALE) + """ SELECT user_key, item, submitted_at, attempt_id, is_ac, is_wa FROM (
      SELECT *, row_number() OVER (PARTITION BY user_key, item, submitted_at
                                   ORDER BY attempt_id DESC, is_ac DESC, is_wa DESC) AS rn FROM att_scale) WHERE rn = 1""",
)
def dedup_newest(inp):
    """W-5: one row per (user, item, submitted_at), newest kept."""
    return O.dedup_newest(inp.att_scale(), ["user_key", "item", "submitted_at"], ["is_ac", "is_wa"])


@register(
    "dedup_pairs",
    Q.with_(Q.ATT_SCALE) + """ SELECT user_key, item, submitted_at, attempt_id, is_ac, is_wa FROM (
      SELECT *, row_number() OVER (PARTITION BY user_key, item
                                   ORDER BY submitted_at DESC NULLS LAST, attempt_id DESC, is_ac DESC, is_wa DESC) AS rn
      FROM att_scale) WHERE rn = 1""",
)
def dedup_pairs(inp):
    """W-6 (old variant): one row per (user, item), newest kept."""
    return O.dedup_newest(inp.att_scale(), ["user_key", "item"], ["is_ac", "is_wa"])


@register(
    "first_try_rates",
    Q.with_(Q.ATT_ORDER, """per AS (
      SELECT user_key, item, count(*) AS n, max(is_ac) AS ever_ac,
             1 - min({'ts': submitted_at, 'id': attempt_id, 'na': 1 - is_ac}).na AS first_ac
      FROM att_order GROUP BY user_key, item)""")
    + """ SELECT user_key,
        round(coalesce(count(*) FILTER (WHERE ever_ac = 1 AND n = 1) / nullif(count(*) FILTER (WHERE ever_ac = 1), 0), 0.0), 6) AS ftr_a,
        round(avg(first_ac), 6) AS ftr_b,
        round(count(*) FILTER (WHERE ever_ac = 1 AND n = 1) / count(*), 6) AS ftr_c,
        count(*) AS n_items
      FROM per GROUP BY user_key""",
)
def first_try_rates(inp):
    """A-20 (a, b, c) with the explicit earliest-attempt order (W-4, V-4, V-20)."""
    return O.first_try_rates(inp.att_order())


_MARKERS = """mk AS (
  SELECT user_key, item, any_value(tags) AS tags,
         max(CASE WHEN verdict = 'OK' THEN {'ts': submitted_at, 'id': attempt_id} END) AS newest_ok,
         max(CASE WHEN verdict IS DISTINCT FROM 'OK' THEN {'ts': submitted_at, 'id': attempt_id} END) AS newest_fail
  FROM att_order GROUP BY user_key, item)"""


@register(
    "tag_accuracy",
    Q.with_(Q.ATT_ORDER, _MARKERS) + """ SELECT user_key, tag, solved, failed,
        CAST(floor(solved * 100.0 / (solved + failed) + 0.5) AS INTEGER) AS accuracy FROM (
      SELECT user_key, tag, count(*) FILTER (WHERE newest_ok IS NOT NULL) AS solved,
             count(*) FILTER (WHERE newest_fail IS NOT NULL AND (newest_ok IS NULL OR newest_fail > newest_ok)) AS failed
      FROM (SELECT user_key, item, newest_ok, newest_fail, unnest(tags) AS tag FROM mk) GROUP BY user_key, tag)
      WHERE solved + failed >= 2""",
)
def tag_accuracy(inp):
    """A-32 / W-7: per-tag accuracy over distinct items, failures counted only before the solve."""
    a = inp.att_order()
    from ..sources import testdata as td
    return O.tag_accuracy(a, td.items(a))


@register(
    "rating_buckets",
    Q.with_(Q.ATT_ORDER, _MARKERS) + """ SELECT user_key, bucket, solved, failed,
        CAST(CASE WHEN solved + failed > 0 THEN floor(solved * 100.0 / (solved + failed) + 0.5) ELSE 0 END AS INTEGER) AS accuracy
      FROM (SELECT a.user_key, CAST(floor(a.item_rating / 100.0 + 0.5) * 100 AS INTEGER) AS bucket,
                   count(*) FILTER (WHERE a.verdict = 'OK') AS solved,
                   count(*) FILTER (WHERE a.verdict IS DISTINCT FROM 'OK' AND (m.newest_ok IS NULL
                                    OR {'ts': a.submitted_at, 'id': a.attempt_id} > m.newest_ok)) AS failed
            FROM att_order a JOIN mk m ON m.user_key = a.user_key AND m.item = a.item
            WHERE a.item_rating > 0 GROUP BY 1, 2)""",
)
def rating_buckets(inp):
    """A-33: solved / failed-before-solve rows per rating bucket."""
    return O.rating_buckets(inp.att_order())


@register(
    "stat_cards",
    Q.with_(Q.ATT_ORDER) + """ SELECT user_key, count(DISTINCT CASE WHEN verdict = 'OK' THEN item END) AS total_solved,
        count(*) AS total_attempts, coalesce(max(CASE WHEN verdict = 'OK' THEN item_rating END), 0) AS max_rating,
        CASE WHEN coalesce(max(CASE WHEN verdict = 'OK' THEN item_rating END), 0) > 0
             THEN max(CASE WHEN verdict = 'OK' THEN item_rating END) ELSE 1200 END AS estimated_rating
      FROM att_order GROUP BY user_key""",
)
def stat_cards(inp):
    """A-34: user stat cards."""
    return O.stat_cards(inp.att_order())


@register(
    "latest_attempts",
    Q.with_(Q.ATT_ORDER) + """ SELECT user_key, item, submitted_at, attempt_id, recency_rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY user_key ORDER BY submitted_at DESC, attempt_id DESC) AS INTEGER) AS recency_rank
      FROM att_order) WHERE recency_rank <= 500""",
)
def latest_attempts(inp):
    """W-8: newest 500 attempts per user."""
    return O.latest_n(inp.att_order()).select("user_key", "item", "submitted_at", "attempt_id", "recency_rank")
