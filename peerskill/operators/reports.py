"""Report aggregates (A-24, A-25, A-29..A-31, A-36, A-41, L-4, L-8, L-9, M-27, M-28).

All are grouped aggregates or windows bounded by a fixed key space (20 tags,
10 rating bins, 8 rank labels, top-k per user)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANK_ORDER, TAGS
from ..session import scratch_path
from .quantile import exact_quantile


def distinct_users(user_tag: DataFrame, approx: bool = False) -> DataFrame:
    """A-24: number of distinct users in the skill table (approx for dashboards)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return user_tag.agg(f("user_key").alias("n_users"))


def rows_per_user(df: DataFrame, more_than: int = 17) -> DataFrame:
    """A-25: users with more than ``more_than`` rows."""
    return df.groupBy("user_key").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > more_than)


def acceptance_by_rating_bin(attempts: DataFrame) -> DataFrame:
    """A-29 / F-28: 10 right-closed bins (0,800] .. (2500,9999]; mean is_ac."""
    edges = [0, 800, 1000, 1200, 1400, 1600, 1800, 2000, 2200, 2500, 9999]
    r = F.col("item_rating")
    b = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond, lab = (r > lo) & (r <= hi), F.lit(f"({lo},{hi}]")
        b = F.when(cond, lab) if b is None else b.when(cond, lab)
    return (attempts.withColumn("rating_bin", b).filter(F.col("rating_bin").isNotNull())
            .groupBy("rating_bin").agg(F.avg("is_ac").alias("acceptance"), F.count(F.lit(1)).alias("n")))


def rank_distribution(profiles: DataFrame) -> DataFrame:
    """A-30 / P-21: count and percent per rank label in ladder order."""
    order = F.array_position(F.array(*[F.lit(r) for r in RANK_ORDER]), F.col("cf_rank"))
    c = profiles.filter(F.col("cf_rank").isin(*RANK_ORDER)).groupBy("cf_rank").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n")).scalar()
    return c.select("cf_rank", order.cast("int").alias("rank_order"), "n", (F.col("n") * 100.0 / total).alias("pct"))


def dataset_summary(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """A-31: users, attempts, min / max rating, mean and population std of the first-try rate."""
    p = profiles.join(pairs.select("user_key").distinct(), "user_key", "left_semi")
    return p.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.min("cf_rating").alias("min_rating"), F.max("cf_rating").alias("max_rating"),
        F.avg("first_try_rate").alias("mean_first_try"), F.stddev_pop("first_try_rate").alias("std_first_try"),
    ).select("*", pairs.agg(F.sum("n_attempts")).scalar().alias("n_attempts"))


def mean_acceptance_over_tags(user_tag: DataFrame) -> DataFrame:
    """A-36: per user, the plain mean of the 20 tag acceptance rates (absent tag = 0)."""
    return user_tag.groupBy("user_key").agg((F.sum("acceptance_rate") / len(TAGS)).alias("mean_acceptance"))


def label_counts(recs: DataFrame) -> DataFrame:
    """A-41: easy / moderate / hard counts over each user's top 50."""
    return (recs.filter(F.col("difficulty_label").isNotNull())
            .groupBy("target_key", "difficulty_label").agg(F.count(F.lit(1)).alias("n")))


def weakest_strongest(bench: DataFrame, n: int = 5) -> DataFrame:
    """L-4: among attempted tags, the n weakest (ascending) and n strongest;
    position 0 = not in that set."""
    ord_ = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    a = bench.filter(F.col("attempted") >= 1)
    up = Window.partitionBy("target_key").orderBy(F.col("strength"), ord_)
    down = Window.partitionBy("target_key").orderBy(F.col("strength").desc(), ord_)
    a = a.withColumn("weak_pos", F.row_number().over(up)).withColumn("strong_pos", F.row_number().over(down))
    return a.filter((F.col("weak_pos") <= n) | (F.col("strong_pos") <= n)).select(
        "target_key", "tag", "strength",
        F.when(F.col("weak_pos") <= n, F.col("weak_pos")).otherwise(F.lit(0)).alias("weak_pos"),
        F.when(F.col("strong_pos") <= n, F.col("strong_pos")).otherwise(F.lit(0)).alias("strong_pos"))


def target_vs_peer_profile(peers: DataFrame, strengths: DataFrame) -> DataFrame:
    """M-27 / A-35: target strength beside the peer mean for every tag."""
    cent = (peers.select("target_key", "peer_key").join(strengths.withColumnRenamed("user_key", "peer_key"), "peer_key")
            .groupBy("target_key", "tag").agg(F.avg("s").alias("peer_mean")))
    return strengths.withColumnRenamed("user_key", "target_key").withColumnRenamed("s", "target_strength").join(
        cent, ["target_key", "tag"])


def recommendation_quadrants(recs: DataFrame) -> DataFrame:
    """M-28: split by the exact median weakness_boost (global) and difficulty_match 0.5.  The two columns are written
    once; the median comes from counting passes over them (``quantile``), not from a sort in one task."""
    path = scratch_path(recs.sparkSession, "quadrants")
    recs.select("weakness_boost", "difficulty_match").write.parquet(path)
    own = recs.sparkSession.read.parquet(path)
    med = F.lit(exact_quantile(own, "weakness_boost", 0.5)).cast("double")
    q = (F.when(F.col("weakness_boost") >= med, F.lit("high_boost")).otherwise(F.lit("low_boost")))
    m = F.when(F.col("difficulty_match") >= 0.5, F.lit("reachable")).otherwise(F.lit("stretch"))
    return own.groupBy(q.alias("boost_half"), m.alias("match_half")).agg(F.count(F.lit(1)).alias("n")).select(
        "*", med.alias("median_boost"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """A-21 / P-16 / F-26: total, accepted, rejected, success rate (0 if
    none) per user, plus the total min-max normalised across users (0 when
    the range is 0; bounds are scalar subqueries)."""
    from ..functions import formulas as fx

    s = attempts.groupBy("user_key").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "OK").alias("accepted"))
    s = s.withColumn("rejected", F.col("total") - F.col("accepted")).withColumn(
        "success_rate", F.when(F.col("total") > 0, F.col("accepted") / F.col("total")).otherwise(F.lit(0.0)))
    lo, hi = s.agg(F.min("total")).scalar(), s.agg(F.max("total")).scalar()
    return s.withColumn("total_norm", fx.min_max_normalise(F.col("total"), lo, hi))


def top_by_final_score(recs: DataFrame, n: int = 5) -> DataFrame:
    """L-8: top n recommendations per user by final score (item on ties)."""
    w = Window.partitionBy("target_key").orderBy(F.round("final_score", 9).desc(), "item")
    return recs.withColumn("final_pos", F.row_number().over(w)).filter(F.col("final_pos") <= n)


def peer_heat_rows(peers: DataFrame, user_tag: DataFrame, n_peers: int = 20, n_heat: int = 10) -> DataFrame:
    """L-9: the 20 nearest peers, with tag strengths for the 10 nearest."""
    top = peers.filter(F.col("rank") <= n_peers)
    heat = top.filter(F.col("rank") <= n_heat).join(
        user_tag.select(F.col("user_key").alias("peer_key"), "tag", "tag_strength"), "peer_key")
    return heat.select("target_key", "peer_key", "rank", "distance", "tag", "tag_strength")


def accuracy_vs_strength(acc: DataFrame, bench: DataFrame) -> DataFrame:
    """J-15: raw tag accuracy beside peer strength; missing strength sorts last (101)."""
    j = acc.join(bench.select(F.col("target_key").alias("user_key"), "tag", "strength"), ["user_key", "tag"], "left")
    w = Window.partitionBy("user_key").orderBy(F.coalesce(F.col("strength"), F.lit(101.0)), "tag")
    return j.withColumn("sort_pos", F.row_number().over(w))
