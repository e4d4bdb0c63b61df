"""Registered queries: vectors, KNN peers, peer benchmark, recommendations (E-2..E-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TAGS
from . import sql_blocks as Q
from .catalog import register, rounded_select

_BASE = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.TAG_DIM, Q.vectors(), Q.peers()]


@register(
    "knn_vectors",
    Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.vectors())
    + " SELECT user_key, CAST(d.i - 1 AS INTEGER) AS dim, round(vec[d.i], 6) AS value"
      " FROM vec, range(1, 83) d(i)",
)
def knn_vectors(inp):
    """A-9: the 82 coordinates per user (long form: user_key, dim, value)."""
    return inp.vectors().select("user_key", F.posexplode("vec").alias("dim", "value"))


_PEER_COLS = ["target_key", "peer_key", "rank", "distance", "similarity", "display_similarity"]


@register(
    "knn_peers",
    Q.with_(*_BASE) + f" SELECT {rounded_select(_PEER_COLS, _PEER_COLS[3:])} FROM peers",
)
def knn_peers(inp):
    """E-3: exact top-50 peers of every user with both similarity scales."""
    return inp.peers().select(*_PEER_COLS)


_BENCH_COLS = [
    "target_key", "tag", "solved", "attempted", "avg_difficulty", "acceptance_rate", "specialization_score",
    "acc_score", "diff_score", "spec_score", "vol_score", "strength", "peer_median_solved",
    "peer_median_acceptance", "peer_median_difficulty", "peer_median_specialization", "tag_rank",
]
_BENCH_DBL = ["avg_difficulty", "acceptance_rate", "specialization_score", "acc_score", "diff_score", "spec_score",
              "vol_score", "strength", "peer_median_solved", "peer_median_acceptance", "peer_median_difficulty",
              "peer_median_specialization"]


@register(
    "peer_benchmark",
    Q.with_(*_BASE, Q.item_stats(), Q.bench()) + f" SELECT {rounded_select(_BENCH_COLS, _BENCH_DBL)} FROM bench",
)
def peer_benchmark(inp):
    """E-2: every user's 20 tag strengths (0-100) against the medians of its peers."""
    return inp.peer_benchmark().select(*_BENCH_COLS)


_REC_COLS = ["target_key", "item", "item_rating", "collab_score", "solve_score", "difficulty_match",
             "weakness_boost", "final_score", "rec_rank", "estimated_attempts", "difficulty_label"]
_REC_DBL = ["collab_score", "solve_score", "difficulty_match", "weakness_boost", "final_score", "estimated_attempts"]


@register(
    "recommendations",
    Q.with_(*_BASE, Q.recommend())
    + f" SELECT {rounded_select(_REC_COLS[:-1], _REC_DBL)}, CASE WHEN estimated_attempts IS NULL THEN NULL"
      " WHEN estimated_attempts < 1.5 THEN 'easy' WHEN estimated_attempts < 2.5 THEN 'moderate' ELSE 'hard' END"
      " AS difficulty_label FROM recs",
)
def recommendations(inp):
    """E-4 / M-16 / M-19: ranked sweet-spot items for every user, with attempts
    estimate and label on the top 50 (closed-form SQL scorer)."""
    return inp.recommendations().select(*_REC_COLS)


_IMP_COLS = ["target_key", "tag", "strength", "delta_problems", "estimated_rating_gain", "label", "impact_rank"]


@register(
    "tag_impact",
    Q.with_(*_BASE, Q.recommend(), Q.impact()) + f" SELECT {rounded_select(_IMP_COLS, ['strength'])} FROM imp",
)
def tag_impact(inp):
    """M-17: per user and tag, extra sweet-spot items if that tag's strength rose by 0.2."""
    return inp.tag_impact().select(*_IMP_COLS)


_POOL_COLS = ["target_key", "item", "item_rating", "collab_score", "pool_rank"]


@register(
    "candidate_pool",
    Q.with_(*_BASE, Q.recommend()) + f" SELECT {rounded_select(_POOL_COLS, ['collab_score'])} FROM pool",
)
def candidate_pool(inp):
    """A-16 / J-5 / J-7 / L-1: top-200 unsolved items by summed peer weight."""
    return inp.pool().select(*_POOL_COLS)


# V-2: vectors of targets from outside the table, whose unattempted tags take their global values (A-23)
_FALLBACK_VECTORS = ["""
  fb AS (SELECT user_key, least((sum(ever_ac) + 1.0) / (count(*) + 2.0), 1.0) AS ga,
                least(coalesce(avg(item_rating) FILTER (WHERE ever_ac = 1), 0.0) / 3500.0, 1.0) AS gd
         FROM fpi WHERE item_rating > 0 GROUP BY user_key),
  vf AS (SELECT u.user_key, [""" + ", ".join(
    [f"coalesce(max(acceptance_rate) FILTER (WHERE tag = '{t}'), any_value(fb.ga), 0.0)" for t in TAGS]
    + [f"coalesce(max(difficulty_score) FILTER (WHERE tag = '{t}'), any_value(fb.gd), 0.0)" for t in TAGS]
    + [f"coalesce(max(specialization_score) FILTER (WHERE tag = '{t}'), 0.0)" for t in TAGS]
    + [f"coalesce(max(volume_score) FILTER (WHERE tag = '{t}'), 0.0)" for t in TAGS]
    + ["coalesce(max(rating_boost), 0.0)", "coalesce(max(efficiency_score), 0.0)"]) + """]::DOUBLE[] AS vec
         FROM user_tag u LEFT JOIN fb ON fb.user_key = u.user_key GROUP BY u.user_key)"""]
_FALLBACK_BASE = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.per_item("clean", "fpi"), *_FALLBACK_VECTORS]


@register(
    "knn_vectors_fallback",
    Q.with_(*_FALLBACK_BASE)
    + " SELECT user_key, CAST(d.i - 1 AS INTEGER) AS dim, round(vec[d.i], 6) AS value FROM vf, range(1, 83) d(i)",
)
def knn_vectors_fallback(inp):
    """A-9 with the V-2 option: unattempted tags take the user's A-23 global acceptance / difficulty."""
    return _fallback_vectors(inp).select("user_key", F.posexplode("vec").alias("dim", "value"))


def _fallback_vectors(inp):
    from ..operators import knn as K
    from ..operators import skill as S

    return K.knn_vectors(inp.user_tag_table(), fallback=S.global_fallback(inp.pairs_table()))


_METRIC_SQL = {
    "euclidean": "list_distance(a.vec, b.vec)",
    "manhattan": "list_sum([abs(a.vec[i] - b.vec[i]) FOR i IN range(1, 83)])",
    "cosine": "1.0 - list_dot_product(a.vec, b.vec) / greatest(sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)), 1e-12)",
}


@register(
    "knn_outside_targets",
    Q.with_(*_FALLBACK_BASE, Q.vectors(), ",".join(
        f"{m}_d AS (SELECT '{m}' AS metric, a.user_key AS target_key, b.user_key AS peer_key, {d} AS distance FROM vf a JOIN vec b ON a.user_key <> b.user_key)"
        for m, d in _METRIC_SQL.items()),
        "all_d AS (" + " UNION ALL ".join(f"SELECT * FROM {m}_d" for m in _METRIC_SQL) + ")",
        "rk AS (SELECT *, max(distance) OVER t AS d_max, row_number() OVER (PARTITION BY metric, target_key ORDER BY round(distance, 9), peer_key) AS rank"
        " FROM all_d WINDOW t AS (PARTITION BY metric, target_key))",
        "top AS (SELECT *, min(distance) OVER t AS d0, max(distance) OVER t AS d1 FROM rk WHERE rank <= 50 WINDOW t AS (PARTITION BY metric, target_key))")
    + """ SELECT metric, target_key, peer_key, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance,
      round((1.0 - (distance - d0) / CASE WHEN d1 > d0 THEN d1 - d0 ELSE 1.0 END) * 100.0, 6) AS similarity,
      round(CASE WHEN d_max > 0 THEN greatest(0.0, 1.0 - distance / d_max) * 100.0 ELSE 100.0 END, 6) AS display_similarity FROM top""",
)
def knn_outside_targets(inp):
    """J-8 / E-3 / F-12: fallback vectors searched in the table of plain ones by each metric, the target's own row left out."""
    from dataclasses import replace

    from ..functions.distance import METRICS
    from ..operators import knn as K
    from .jobs import materialize

    targets, table = materialize(inp.spark, _fallback_vectors(inp), "targets"), materialize(inp.spark, inp.vectors(), "vectors")
    each = [K.nearest_peers(targets, table, replace(inp.settings.knn, metric=m)).select(F.lit(m).alias("metric"), *_PEER_COLS) for m in METRICS]
    return each[0].unionByName(each[1]).unionByName(each[2])
