"""Recommendation jobs for all targets at once (A-15..A-18, J-5, J-7, L-1, L-2,
M-16, M-17, M-19, E-4).

Shapes and bounds:
* the candidate pool is peers (N x k) joined to each peer's distinct solved
  items, shuffled once by target and summed per (target, item) without the
  target's solved items; peers that many targets share are dealt to several
  tasks by their number of pairs (``skew.salted_join``);
* every per-target window is over at most ``limit`` (200) rows, or 20 tags;
* per-user strength maps hold at most 20 entries (fixed vocabulary).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CF_BOOST, DEFAULT_RATING, PROBLEMS_PER_50_RATING, TAGS, RecommendConfig
from ..functions import formulas as fx
from . import scoring as SC
from .skew import salted_join


# A-18 / U-4 -------------------------------------------------------------------

def item_metadata(items: DataFrame) -> DataFrame:
    """A-18: one row per rated item (rating, tags) from the item dimension."""
    return items.filter(F.col("item_rating") > 0).select("item", "item_rating", "tags")


def solved_pairs(pairs: DataFrame) -> DataFrame:
    """U-4: distinct (user, item) with an accepted attempt (the pair table is
    already one row per (user, item))."""
    return pairs.filter(F.col("ever_ac") == 1).select("user_key", "item")


# A-16 / J-5 / J-7 / L-1 ---------------------------------------------------------

def collaborative_candidates(peers: DataFrame, pairs: DataFrame, items: DataFrame, limit: int = 200,
                             weight_col: str = "similarity") -> DataFrame:
    """Pool of items peers solved and the target did not, scored by the sum of
    peer weights (weight = similarity / 100; the k-th peer weighs 0 and its
    items stay with score 0, V-6), inner-joined to rated item metadata and cut
    to the top ``limit`` per target by (score desc, item)."""
    # only rated items of the dimension can be in the pool (J-7): the join
    # below is the O(N x k x solved) step of E-4, so shrink it first.  Its rows
    # are shuffled once, by target; the target's own solved items come along as
    # marks, and metadata is joined to the rows that the cut leaves
    meta = item_metadata(items)
    rated = solved_pairs(pairs.filter(F.col("item_rating") > 0)).join(meta.select("item").distinct(), "item", "left_semi")
    w = peers.select("target_key", "peer_key", (F.col(weight_col) / 100.0).alias("w"))
    met = salted_join(w, rated.select(F.col("user_key").alias("peer_key"), "item"), "peer_key", "target_key", "item")
    own = rated.select(F.col("user_key").alias("target_key"), "item", F.lit(None).cast("double").alias("w"), F.lit(True).alias("own"))
    pool = (
        met.select("target_key", "item", "w", F.lit(False).alias("own")).unionByName(own)
        .repartition("target_key")
        .groupBy("target_key", "item")
        .agg(F.sum("w").alias("collab_score"), F.max("own").alias("own"))
        .filter(~F.col("own")).drop("own")
    )
    # order keys rounded to 1e-9 so float summation order cannot flip ties
    rn = F.row_number().over(
        Window.partitionBy("target_key").orderBy(F.round("collab_score", 9).desc(), "item"))
    cut = pool.withColumn("pool_rank", rn).filter(F.col("pool_rank") <= limit)
    return cut.join(meta, "item").select("item", "target_key", "collab_score", "item_rating", "tags", "pool_rank")


def collaborative_candidates_rr(peers: DataFrame, pairs: DataFrame, items: DataFrame, limit: int = 300) -> DataFrame:
    """A-17 / W-9 variant: weight = 1 / rank (rank from 1 = 1/(rank0+1))."""
    p = peers.withColumn("rr_weight", F.lit(100.0) / F.col("rank"))
    return collaborative_candidates(p, pairs, items, limit, weight_col="rr_weight")


# A-15 -----------------------------------------------------------------------------

def weighted_peer_strength(peers: DataFrame, user_tag: DataFrame) -> DataFrame:
    """A-15: per (target, tag) sum(w * s) / sum(w), w = display_similarity / 100;
    0.5 when the weight sum is 0 or no peer has the tag.  All 20 tags."""
    w = peers.select("target_key", "peer_key", (F.col("display_similarity") / 100.0).alias("w"))
    own = user_tag.groupBy(F.col("user_key").alias("peer_key")).agg(
        F.array(*[F.max(F.when(F.col("tag") == t, F.col("tag_strength"))) for t in TAGS]).alias("s"))  # a row per peer, 20 slots
    joined = salted_join(w, own, "peer_key", "target_key", "peer_key")
    cells = []
    for i in range(len(TAGS)):
        s = F.get("s", F.lit(i))
        cells += [F.sum(F.col("w") * s), F.sum(F.when(s.isNotNull(), F.col("w")))]
    sums = joined.groupBy("target_key").agg(F.array(*cells).alias("sums"))
    grid = peers.select("target_key").distinct().join(sums, "target_key", "left").select(
        "target_key", "sums", F.posexplode(F.array(*[F.lit(t) for t in TAGS])).alias("ord", "tag"))
    ws, sw = F.get("sums", F.col("ord") * 2), F.get("sums", F.col("ord") * 2 + 1)
    return grid.select("target_key", "tag", F.when(sw > 0, ws / sw).otherwise(F.lit(0.5)).alias("peer_strength"))


def strength_map(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, tag, value) -> (key, map<tag, value>); at most 20 entries per key."""
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", value))).alias(out))


# Feature frame for the pool --------------------------------------------------------

def user_context(user_tag: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per target: strength map, rating used for scoring (1200 when missing or
    <= 0, J-6), num_solved = distinct rated solved items (V-13)."""
    smap = strength_map(user_tag, "user_key", "tag_strength", "smap")
    n_solved = (
        pairs.filter((F.col("ever_ac") == 1) & (F.col("item_rating") > 0))
        .groupBy("user_key").agg(F.count(F.lit(1)).alias("num_solved"))
    )
    rating = F.when(F.col("cf_rating") > 0, F.col("cf_rating")).otherwise(F.lit(DEFAULT_RATING))
    return (
        profiles.select("user_key", rating.alias("user_rating"))
        .join(smap, "user_key", "left")
        .join(n_solved, "user_key", "left")
        .select(
            F.col("user_key").alias("target_key"), "user_rating",
            F.coalesce("smap", F.create_map().cast("map<string,double>")).alias("smap"),
            F.coalesce("num_solved", F.lit(0)).alias("num_solved"),
        )
    )


def candidate_features(pool: DataFrame, ctx: DataFrame) -> DataFrame:
    """M-1 style feature frame for every (target, candidate item)."""
    j = pool.join(ctx, "target_key").withColumn("strengths", SC.strength_lookup(F.col("smap"), F.col("tags")))  # looked up once a row
    return j.select(
        "target_key", "item", "item_rating", "tags", "collab_score", "smap",
        *SC.feature_columns(F.col("tags"), F.col("item_rating"), F.col("user_rating"), F.col("num_solved"), F.col("strengths")),
    )


# M-16 / L-2 / M-19 -----------------------------------------------------------------

def _weakness_boost() -> Column:
    """F-20: mean of (1 - user) x peer strength over the item's tags, from the maps ``smap`` and ``pmap``; 0 without tags."""
    contrast = F.transform(
        F.col("tags"),
        lambda t: (F.lit(1.0) - F.coalesce(F.element_at("smap", t), F.lit(0.0)))
        * F.coalesce(F.element_at("pmap", t), F.lit(0.0)),
    )
    n = F.size("tags")
    return F.when(n > 0, F.aggregate(contrast, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))


def prioritise(features: DataFrame, peer_strength: DataFrame, cfg: RecommendConfig = RecommendConfig(),
               success_scorer=SC.sql_success_scorer, attempts_scorer=SC.sql_attempts_scorer) -> DataFrame:
    """M-16: score, keep the sweet spot (P-20), weakness boost (F-20: mean of
    (1 - user) x peer over the item's tags), difficulty match (F-19), final
    score (F-21: alpha x match + beta x boost), order by
    (weakness_boost desc, final_score desc, item); M-19 attaches the attempts
    estimate and label to the top ``cfg.top_attempts``."""
    scored = success_scorer(features).filter(F.col("solve_score").between(cfg.sweet_lo, cfg.sweet_hi))
    pmap = strength_map(peer_strength, "target_key", "peer_strength", "pmap")
    s = scored.join(pmap, "target_key", "left")
    s = (
        s.withColumn("weakness_boost", _weakness_boost())
        .withColumn("difficulty_match", fx.difficulty_match(F.col("solve_score")))
        .withColumn("final_score", F.lit(cfg.alpha) * F.col("difficulty_match") + F.lit(cfg.beta) * F.col("weakness_boost"))
    )
    w = Window.partitionBy("target_key").orderBy(
        F.round("weakness_boost", 9).desc(), F.round("final_score", 9).desc(), "item")
    s = s.withColumn("rec_rank", F.row_number().over(w))
    # M-19 / J-13 on the top ``top_attempts`` only: a guarded column, no join back
    s = attempts_scorer(s)
    est = F.when(F.col("rec_rank") <= cfg.top_attempts, SC.clip_attempts(F.col("attempts_raw")))
    return s.withColumn("estimated_attempts", est).withColumn(
        "difficulty_label", F.when(est.isNotNull(), fx.difficulty_label(est))).drop("attempts_raw")


def prioritise_variant(features: DataFrame, peer_median: DataFrame, keep: int = 50, cfg: RecommendConfig = RecommendConfig(),
                       success_scorer=SC.sql_success_scorer, attempts_scorer=SC.sql_attempts_scorer) -> DataFrame:
    """M-16 / L-2 / F-19 / F-21 of the self-contained variant: items without tags are left out, the peers' side of the boost is the
    median strength of the peers that have the tag (``peer_median``: target_key, tag, peer_strength; 0 when none has it),
    the match is score + 0.2, scores are rounded to 3 decimals before they are ordered, and ``keep`` items stay a target,
    each with an attempts estimate (2 decimals), its label (of the estimate before rounding) and the tags' long names."""
    scored = success_scorer(features.filter(F.size("tags") > 0)).filter(F.col("solve_score").between(cfg.sweet_lo, cfg.sweet_hi))
    s = scored.join(strength_map(peer_median, "target_key", "peer_strength", "pmap"), "target_key", "left")
    boost, match = _weakness_boost(), fx.difficulty_match_variant(F.col("solve_score"))
    s = attempts_scorer(s).select(
        "target_key", "item", "item_rating", F.transform("tags", fx.long_tag_label).alias("tag_labels"),
        fx.at_sink(F.col("solve_score"), 3).alias("solve_score"), fx.at_sink(match, 3).alias("difficulty_match"),
        fx.at_sink(boost, 3).alias("weakness_boost"), fx.at_sink(F.lit(cfg.alpha) * match + F.lit(cfg.beta) * boost, 3).alias("final_score"),
        fx.at_sink(F.col("attempts_raw"), 2).alias("estimated_attempts"), fx.difficulty_label(F.round("attempts_raw", 9)).alias("difficulty_label"))
    order = Window.partitionBy("target_key").orderBy(F.col("weakness_boost").desc(), F.col("final_score").desc(), "item")
    return s.withColumn("rec_rank", F.row_number().over(order)).filter(F.col("rec_rank") <= keep)


# M-17 / J-12 / A-37 / F-24 / F-25 / L-5 -----------------------------------------------

def counterfactual_impact(features: DataFrame, ctx: DataFrame, cfg: RecommendConfig = RecommendConfig(),
                          success_scorer=SC.sql_success_scorer, signed: bool = False) -> DataFrame:
    """M-17: for each target and tag, how many more pool items fall in the
    sweet spot when that tag's strength is raised by 0.2 (capped at 1).
    ``signed`` gives the variant: losses stay negative, the gain is five
    points an item, labels are long and the strength has 3 decimals.
    ``success_scorer`` is any ``score(df) -> df`` over the feature frame that
    adds ``solve_score``, a formula or a fitted model.

    Raising tag t only changes items that carry t, so instead of crossing the
    pool with 21 scenarios the item rows are exploded over their own 3-4 tags
    (a generator, no join), their features are built anew and scored, and the
    change in the sweet-spot indicator is summed per (target, tag), then put
    into one map per target.  The frame is read once: an item without tags
    stays as a row without tag, so a target with any item has its table."""
    in_sweet = F.col("solve_score").between(cfg.sweet_lo, cfg.sweet_hi).cast("int")
    base = success_scorer(features).withColumn("base_in", in_sweet)
    own_tags = base.select("target_key", "item_rating", "tags", "cf_rating", "num_solved", "base_in",
                           SC.strength_lookup(F.col("smap"), F.col("tags")).alias("strengths"), F.explode_outer("tags").alias("tag"))
    # strengths are looked up once an item; a column of its own is not computed again for each feature that is made of it
    own_tags = own_tags.withColumn("raised", F.transform(
        "strengths", lambda s, i: F.when(F.get("tags", i) == F.col("tag"), F.least(F.lit(1.0), s + CF_BOOST)).otherwise(s)))
    per_tag = success_scorer(own_tags.select("target_key", "tag", "base_in", *SC.feature_columns(
        F.col("tags"), F.col("item_rating"), F.col("cf_rating"), F.col("num_solved"), F.col("raised"))))
    change = in_sweet - F.col("base_in")
    deltas = per_tag.groupBy("target_key", "tag").agg(F.sum(change).alias("raw_delta"))
    # only targets with a non-empty pool get an impact table
    changed = F.when(F.col("tag").isNotNull(), F.struct("tag", "raw_delta"))
    targets = deltas.groupBy("target_key").agg(F.map_from_entries(F.collect_list(changed)).alias("deltas")).join(ctx.select("target_key", "smap"), "target_key")
    grid = targets.select("target_key", "smap", "deltas", F.posexplode(F.array(*[F.lit(t) for t in TAGS])).alias("ord", "tag"))
    delta = F.coalesce(F.element_at("deltas", F.col("tag")), F.lit(0))
    out = grid.select(
        "target_key", "tag", "ord",
        F.coalesce(F.element_at("smap", F.col("tag")), F.lit(0.0)).alias("strength"),
        (delta if signed else F.greatest(delta, F.lit(0))).cast("int").alias("delta_problems"),
    )
    per_item = F.lit(50.0 / PROBLEMS_PER_50_RATING)
    out = out.withColumn("estimated_rating_gain", F.round(F.col("delta_problems") * per_item).cast("int")).withColumn(
        "label", fx.long_tag_label(F.col("tag")) if signed else fx.tag_label(F.col("tag")))
    if signed:
        out = out.withColumn("strength", fx.at_sink(F.col("strength"), 3))
    w = Window.partitionBy("target_key").orderBy(F.col("delta_problems").desc(), F.col("estimated_rating_gain").desc(),
                                                 "ord")
    return out.withColumn("impact_rank", F.row_number().over(w)).drop("ord")


def top_impacts(impact: DataFrame, n: int = 8) -> DataFrame:
    """L-5, the shown part: the first ``n`` tags of a target whose raise gains items (fewer where fewer do)."""
    return impact.filter((F.col("delta_problems") > 0) & (F.col("impact_rank") <= n))
