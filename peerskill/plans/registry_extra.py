"""Registered queries: target-side variants, attempt stats, UI joins and report views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas as fx
from ..operators import ordered as O
from ..operators import reports as RP
from ..operators import skill as S
from . import sql_blocks as Q
from .catalog import register, rounded_select

_UT = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag()]
_PEERS = _UT + [Q.TAG_DIM, Q.vectors(), Q.peers()]
_RT = """rt AS (SELECT CAST(c_custkey AS BIGINT) AS user_key,
         CASE WHEN c_custkey % 19 <> 3 THEN CAST(900 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 1700 AS INTEGER) ELSE 0 END AS cf_rating,
         CASE WHEN c_custkey % 19 <> 3 THEN CAST(900 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 1700 + c_custkey % 300 AS INTEGER) ELSE 0 END AS cf_max_rating
  FROM customer)"""


@register("target_side_strength", Q.with_(*_UT, Q.TAG_DIM, Q.per_item("clean", "tpi"), _RT, """
  tu AS (SELECT user_key, sum(ever_ac) AS tot,
           coalesce(count(*) FILTER (WHERE ever_ac = 1 AND n_attempts = 1) / nullif(count(*) FILTER (WHERE ever_ac = 1), 0), 0.0) AS ftr
         FROM tpi GROUP BY user_key),
  tt AS (SELECT user_key, tag, count(*) AS n, sum(ever_ac) AS ac, avg(item_rating) FILTER (WHERE ever_ac = 1) AS avs
         FROM (SELECT user_key, ever_ac, item_rating, unnest(tags) AS tag FROM tpi) GROUP BY 1, 2),
  ts AS (SELECT u.user_key, d.tag, CASE WHEN t.n IS NULL THEN 0.0 ELSE least(greatest(
      coalesce((t.ac + 1.0) / (t.n + 2.0), 0.0) * 0.30
    + coalesce(CASE WHEN t.ac > 0 THEN t.avs / 3500.0 ELSE 0.0 END, 0.0) * 0.30
    + coalesce(least((r.cf_rating + r.cf_max_rating) / 7000.0, 1.0), 0.0) * 0.20
    + coalesce(CASE WHEN u.tot > 0 THEN least(t.ac / u.tot, 1.0) ELSE 0.0 END, 0.0) * 0.10
    + coalesce(least(u.ftr, 1.0), 0.0) * 0.075
    + coalesce(least(greatest(ln(1 + t.ac) / ln(51), 0.0), 1.0), 0.0) * 0.075, 0.0), 1.0) END AS target_strength
    FROM tu u CROSS JOIN tag_dim d LEFT JOIN tt t ON t.user_key = u.user_key AND t.tag = d.tag
    LEFT JOIN rt r ON r.user_key = u.user_key)""")
    + " SELECT user_key, tag, round(target_strength, 6) AS target_strength FROM ts")
def target_side_strength(inp):
    """A-6 / A-20(a) / V-3: target-side tag strength at distinct-item grain."""
    return S.target_side_strength(inp.pairs(), inp.items(), inp.ratings())


@register("global_fallback", Q.with_(*_UT, Q.per_item("clean", "gpi")) + """ SELECT user_key,
      round(least((sum(ever_ac) + 1.0) / (count(*) + 2.0), 1.0), 6) AS global_acceptance,
      round(least(coalesce(avg(item_rating) FILTER (WHERE ever_ac = 1), 0.0) / 3500.0, 1.0), 6) AS global_difficulty
    FROM gpi WHERE item_rating > 0 GROUP BY user_key""")
def global_fallback(inp):
    """A-23: smoothed overall acceptance and solved-rating score per user."""
    return S.global_fallback(inp.pairs())


@register("attempt_stats", Q.with_(Q.ATT_SCALE, """s AS (SELECT user_key, count(*) AS total,
      count(*) FILTER (WHERE verdict = 'OK') AS accepted FROM att_scale GROUP BY user_key)""")
    + """ SELECT user_key, total, accepted, total - accepted AS rejected,
      round(CASE WHEN total > 0 THEN accepted * 1.0 / total ELSE 0.0 END, 6) AS success_rate,
      round(CASE WHEN (SELECT max(total) - min(total) FROM s) = 0 THEN 0.0
                 ELSE (total - (SELECT min(total) FROM s)) * 1.0 / (SELECT max(total) - min(total) FROM s) END, 6) AS total_norm
    FROM s""")
def attempt_stats(inp):
    """A-21 / F-26: per-user attempt statistics over the raw attempt log."""
    return RP.attempt_stats(inp.att_scale())


@register("plan_bounds", Q.with_(*_UT) + """ SELECT user_key, cf_rating, greatest(800, cf_rating - 300) AS comfort_floor,
      least(3500, cf_rating + 100) AS comfort_ceiling, least(3500, cf_rating + 300) AS stretch_ceiling FROM profiles""")
def plan_bounds(inp):
    """F-29: practice-band bounds around each user's rating."""
    return inp.profiles().select("user_key", "cf_rating", *fx.plan_bounds(F.col("cf_rating")))


@register("top5_by_final_score", Q.with_(*_PEERS, Q.recommend()) + """ SELECT target_key, item, round(final_score, 6) AS final_score,
      final_pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_key ORDER BY round(final_score, 9) DESC, item) AS INTEGER) AS final_pos
      FROM recs) WHERE final_pos <= 5""")
def top5_by_final_score(inp):
    """L-8: five best recommendations per user by final score."""
    return RP.top_by_final_score(inp.recommendations()).select("target_key", "item", "final_score", "final_pos")


@register("peer_heat_rows", Q.with_(*_PEERS) + """ SELECT p.target_key, p.peer_key, p.rank, round(p.distance, 6) AS distance,
      u.tag, round(u.tag_strength, 6) AS tag_strength FROM peers p JOIN user_tag u ON u.user_key = p.peer_key WHERE p.rank <= 10""")
def peer_heat_rows(inp):
    """L-9: tag strengths of each user's 10 nearest peers (of the top 20)."""
    return RP.peer_heat_rows(inp.peers(), inp.user_tag_table())


_ACC = """mk AS (
  SELECT user_key, item, max(CASE WHEN verdict = 'OK' THEN {'ts': submitted_at, 'id': attempt_id} END) AS newest_ok,
         max(CASE WHEN verdict IS DISTINCT FROM 'OK' THEN {'ts': submitted_at, 'id': attempt_id} END) AS newest_fail,
         any_value(tags) AS tags
  FROM att_scale GROUP BY user_key, item),
acc AS (SELECT user_key, tag, solved, failed, CAST(floor(solved * 100.0 / (solved + failed) + 0.5) AS INTEGER) AS accuracy FROM (
  SELECT user_key, tag, count(*) FILTER (WHERE newest_ok IS NOT NULL) AS solved,
         count(*) FILTER (WHERE newest_fail IS NOT NULL AND (newest_ok IS NULL OR newest_fail > newest_ok)) AS failed
  FROM (SELECT user_key, item, newest_ok, newest_fail, unnest(tags) AS tag FROM mk) GROUP BY 1, 2) WHERE solved + failed >= 2)"""


@register("accuracy_vs_strength", Q.with_(*_PEERS, Q.item_stats(), Q.bench(), _ACC) + """ SELECT a.user_key, a.tag, a.solved, a.failed,
      a.accuracy, round(b.strength, 6) AS strength,
      CAST(row_number() OVER (PARTITION BY a.user_key ORDER BY coalesce(b.strength, 101.0), a.tag) AS INTEGER) AS sort_pos
    FROM acc a LEFT JOIN bench b ON b.target_key = a.user_key AND b.tag = a.tag""")
def accuracy_vs_strength(inp):
    """J-15 / A-32: per-tag accuracy of the attempt log beside the peer strength
    (users without a benchmark keep accuracy only; missing strength sorts last)."""
    acc = O.tag_accuracy(inp.att_scale(), inp.items())
    out = RP.accuracy_vs_strength(acc, inp.peer_benchmark())
    return out.select("user_key", "tag", "solved", "failed", "accuracy", "strength", "sort_pos")
