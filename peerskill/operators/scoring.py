"""Pluggable scorers over the (target, item) feature frame (X-3).

A scorer is ``score(df) -> df`` that adds ``solve_score`` (success) or
``attempts_raw`` (attempts).  Two kinds exist:

* closed-form SQL scorers (this module): plain Column arithmetic, so every
  ranking / counterfactual / label that depends on them can be checked
  exactly against a SQL oracle;
* Spark ML scorers (``models.py``): a fitted ``PipelineModel`` applied with
  ``transform`` - the production path, checked by invariants.

Feature columns (29, same names and order as the success model expects):
rating_diff, rating_diff_sq, cf_rating, mean_tag_strength, tag_strength_min,
tag_strength_max, tag_coverage, num_solved, problem_tag_count, tag_<t> x 20.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ATTEMPTS_CLIP, TAGS
from ..functions import formulas as fx

FEATURE_NAMES = [
    "rating_diff", "rating_diff_sq", "cf_rating", "mean_tag_strength", "tag_strength_min",
    "tag_strength_max", "tag_coverage", "num_solved", "problem_tag_count",
] + [f"tag_{t}" for t in TAGS]


def strength_lookup(smap: Column, tags: Column) -> Column:
    """User strengths of the item's tags (missing -> 0) as an array."""
    return F.transform(tags, lambda t: F.coalesce(F.element_at(smap, t), F.lit(0.0)))


def feature_columns(tags: Column, rating: Column, user_rating: Column, num_solved: Column,
                    strengths: Column) -> list[Column]:
    """F-16..F-18 (F-17: active-tag mean / min / max) from an item tag array and the matching user strengths
    (inference semantics: no tags -> mean/min/max 0, V-8)."""
    n = F.size(strengths)
    mean = F.when(n > 0, F.aggregate(strengths, F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))
    mn = F.when(n > 0, F.array_min(strengths)).otherwise(F.lit(0.0))
    mx = F.when(n > 0, F.array_max(strengths)).otherwise(F.lit(0.0))
    diff = (rating - user_rating).cast("double")
    return [
        diff.alias("rating_diff"),
        (diff * diff).alias("rating_diff_sq"),
        user_rating.cast("double").alias("cf_rating"),
        mean.alias("mean_tag_strength"),
        mn.alias("tag_strength_min"),
        mx.alias("tag_strength_max"),
        (n / F.lit(float(len(TAGS)))).alias("tag_coverage"),
        num_solved.cast("double").alias("num_solved"),
        n.cast("double").alias("problem_tag_count"),
        *[F.array_contains(tags, t).cast("double").alias(f"tag_{t}") for t in TAGS],
    ]


# Closed-form scorers (the SQL-checkable stand-ins) ----------------------------

def sql_solve_score(rating_diff: Column, mean_ts: Column) -> Column:
    """solve_score = clip(0.1 - rating_diff / 1000 + mean_tag_strength, -1, 1)."""
    return fx.clip(F.lit(0.1) - rating_diff / F.lit(1000.0) + mean_ts, -1.0, 1.0)


def sql_attempts(rating_diff: Column, mean_ts: Column) -> Column:
    """attempts = 1 + max(rating_diff, 0) / 400 + (1 - mean_tag_strength)."""
    return F.lit(1.0) + F.greatest(rating_diff, F.lit(0.0)) / F.lit(400.0) + (F.lit(1.0) - mean_ts)


def sql_success_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("solve_score", sql_solve_score(F.col("rating_diff"), F.col("mean_tag_strength")))


def sql_attempts_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("attempts_raw", sql_attempts(F.col("rating_diff"), F.col("mean_tag_strength")))


def clip_attempts(c: Column, hi: float = ATTEMPTS_CLIP) -> Column:
    """F-23: clip to [1, hi]."""
    return fx.clip(c, 1.0, float(hi))
