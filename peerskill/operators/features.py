"""Model feature frames (M-1, M-2) and targets (F-13..F-15, A-26..A-28)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ATTEMPTS_CLIP, DEFAULT_RATING, PROFILE_FEATURES, TAGS
from ..functions import formulas as fx
from . import evaluate as EV
from . import recommend as R
from . import scoring as SC
from . import skill as S

WA_PENALTY = 0.2


def success_frame(pairs: DataFrame, items: DataFrame, user_tag: DataFrame, profiles: DataFrame) -> DataFrame:
    """M-1: one row per rated (user, item) of users in the skill table, the
    29 features, solve_score target (F-13) and a deterministic 80/20 split."""
    # J-4: semi-join to the users of the skill table
    rated = pairs.filter(F.col("item_rating") > 0).join(user_tag.select("user_key").distinct(), "user_key", "left_semi")
    smap = R.strength_map(user_tag, "user_key", "tag_strength", "smap")
    n_solved = rated.filter(F.col("ever_ac") == 1).groupBy("user_key").agg(F.count(F.lit(1)).alias("num_solved"))
    rating = profiles.select("user_key", F.coalesce("cf_rating", F.lit(DEFAULT_RATING)).alias("user_rating"))
    j = (S.with_tags(rated, items).join(smap, "user_key", "left").join(n_solved, "user_key", "left")
         .join(rating, "user_key", "left")
         .withColumn("user_rating", F.coalesce("user_rating", F.lit(DEFAULT_RATING)))
         .withColumn("num_solved", F.coalesce("num_solved", F.lit(0)))
         .withColumn("smap", F.coalesce("smap", F.create_map().cast("map<string,double>"))))
    strengths = SC.strength_lookup(F.col("smap"), F.col("tags"))
    y = fx.clip(F.col("ever_ac") - F.col("wa_count") * WA_PENALTY, -1.0, 1.0)
    key = F.concat_ws("|", F.col("user_key").cast("string"), F.col("item"))
    return j.select(
        "user_key", "item", "item_rating", "ever_ac", "wa_count",
        *SC.feature_columns(F.col("tags"), F.col("item_rating"), F.col("user_rating"), F.col("num_solved"), strengths),
        y.alias("solve_score"), EV.split_flag(key).alias("split"),
    )


def attempts_frame(success: DataFrame) -> DataFrame:
    """M-1 for the attempts model: solved rows, target least(wa + 1, 10) (F-14)."""
    return success.filter(F.col("ever_ac") == 1).withColumn(
        "attempts", F.least(F.col("wa_count") + 1, F.lit(ATTEMPTS_CLIP)).cast("double"))


def growth_frame(profiles: DataFrame, user_tag: DataFrame) -> DataFrame:
    """M-2: profile features + 20 strengths (J-3 inner join, null -> 0), target
    growth = greatest(max_rating - rating, 0) (F-15); one row per user."""
    piv = S.strength_pivot(user_tag, fill=0.0)
    prof = profiles.dropDuplicates(["user_key"])  # V-12
    j = prof.join(piv, "user_key", "inner")
    feats = PROFILE_FEATURES + [f"strength_{t}" for t in TAGS]
    return j.select(
        "user_key", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats],
        F.greatest(F.col("cf_max_rating") - F.col("cf_rating"), F.lit(0)).cast("double").alias("growth"),
        EV.split_flag(F.col("user_key").cast("string")).alias("split"),
    )


def score_distribution(success: DataFrame) -> DataFrame:
    """A-26: share of rows per half-open solve_score bucket."""
    s = F.col("solve_score")
    buckets = [("share_neg", -1.0, 0.0), ("share_0_05", 0.0, 0.5), ("share_05_09", 0.5, 0.9), ("share_09_1", 0.9, 1.01)]
    return success.agg(*[F.avg(((s >= lo) & (s < hi)).cast("double")).alias(name) for name, lo, hi in buckets])


def attempts_distribution(att: DataFrame) -> DataFrame:
    """A-27: share at 1..5 attempts and > 5."""
    a = F.col("attempts")
    return att.agg(*[F.avg((a == i).cast("double")).alias(f"share_{i}") for i in range(1, 6)],
                   F.avg((a > 5).cast("double")).alias("share_gt5"))


def growth_stats(g: DataFrame) -> DataFrame:
    """A-28: mean, median, max, count > 200 of the growth target."""
    return g.agg(F.avg("growth").alias("mean_growth"), F.median("growth").alias("median_growth"),
                 F.max("growth").alias("max_growth"), F.count_if(F.col("growth") > 200).alias("n_over_200"))
