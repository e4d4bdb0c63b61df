"""Evaluation jobs (M-3, M-9..M-13, M-20, M-22, M-25, M-26, W-10, W-11).

Everything is an aggregate or a bounded window: per-user windows hold 20 tag
rows, global orderings (exact AUC) go through a distributed prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism as _parallelism

from ..config import ERROR_BANDS, TAGS, WEAK_THRESHOLD


# M-3 / W-11: deterministic hash split and folds ---------------------------------

def hash_bucket(key: Column, n: int) -> Column:
    """md5-based bucket, reproducible in SQL as
    ('0x' || substr(md5(k), 1, 8))::BIGINT % n."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def split_flag(key: Column, test_buckets: int = 1, n: int = 5) -> Column:
    """M-3: 80/20 row split; bucket < test_buckets is the test side."""
    return F.when(hash_bucket(key, n) < test_buckets, F.lit("test")).otherwise(F.lit("train"))


# Distributed prefix sum ------------------------------------------------------------

def prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str, n_parts: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ascending ``order_col`` order
    (rows with equal order value get the same prefix).  Range-partitioned so
    equal keys share a partition; per-partition totals (one row each) give the
    offsets; inside a partition a window over that partition only."""
    n_parts = n_parts or _parallelism(df.sparkSession)
    g = df.groupBy(order_col).agg(F.sum(value_col).alias("_v"))
    ranged = g.repartitionByRange(n_parts, order_col).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    tot = ranged.groupBy("_pid").agg(F.sum("_v").alias("_t"))
    offs = tot.select("_pid", F.coalesce(
        F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offs, "_pid").select(
        order_col, F.col("_v").alias(value_col),
        (F.col("_off") + F.coalesce(F.sum("_v").over(w), F.lit(0))).alias(out),
    )


def exact_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """M-10 AUC with tie-averaged ranks (W-10): sum over distinct scores of
    pos * (neg below + neg at / 2) / (P * N)."""
    g = df.groupBy(score).agg(F.sum(F.col(label)).alias("pos"), F.sum(F.lit(1) - F.col(label)).alias("neg"))
    below = prefix_sum(g, score, "neg", "neg_below")
    j = g.join(below.select(score, "neg_below"), score)
    return j.agg(
        (F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)) / (F.sum("pos") * F.sum("neg"))).alias("auc")
    )


# M-9 / M-10 -----------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """MAE, MSE, RMSE, R^2 in one aggregate (R^2 = 1 - SSE / SST)."""
    err = F.col(p) - F.col(y)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.lit(1.0) - F.sum(err * err) / (F.count(F.lit(1)) * F.var_pop(y))).alias("r2"),
    )


def binary_metrics(df: DataFrame, y: str = "y", p: str = "pred", threshold: float = 0.5) -> DataFrame:
    """Confusion counts and F1 at a threshold on a regression output (M-10)."""
    yt, yp = F.col(y) >= threshold, F.col(p) >= threshold
    c = df.agg(
        F.count_if(yt & yp).alias("tp"), F.count_if(~yt & yp).alias("fp"),
        F.count_if(yt & ~yp).alias("fn"), F.count_if(~yt & ~yp).alias("tn"),
    )
    return c.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
                        .otherwise(F.lit(0.0)))


def mae_by_band(df: DataFrame, rating: str, y: str = "y", p: str = "pred", bands=ERROR_BANDS) -> DataFrame:
    """M-11: MAE and n per [lo, hi) rating band."""
    band = None
    for lo, hi in bands:
        cond = (F.col(rating) >= lo) & (F.col(rating) < hi)
        label = F.lit(f"{lo}-{hi}")
        band = F.when(cond, label) if band is None else band.when(cond, label)
    return (df.withColumn("band", band).filter(F.col("band").isNotNull())
            .groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(p) - F.col(y))).alias("mae")))


def calibration(df: DataFrame, y: str = "y", p: str = "pred", lo: int = 1, hi: int = 5, min_n: int = 10) -> DataFrame:
    """M-12: mean prediction per actual value lo..hi, groups with n > min_n."""
    return (df.filter(F.col(y).between(lo, hi)).groupBy(F.col(y).cast("int").alias("actual"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred")).filter(F.col("n") > min_n))


def residual_histogram(df: DataFrame, y: str = "y", p: str = "pred", bins: int = 60) -> DataFrame:
    """M-25: equal-width histogram of residuals (pred - y) over [min, max];
    the max lands in the last bin.  Bounds are scalar subqueries (one
    aggregate each), not a join."""
    r = df.select((F.col(p) - F.col(y)).alias("r"))
    lo, hi = r.agg(F.min("r")).scalar(), r.agg(F.max("r")).scalar()
    mean_r = r.agg(F.avg("r")).scalar()
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor((F.col("r") - lo) / width), F.lit(bins - 1))).cast("int")
    return r.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", "n", lo.alias("lo"), hi.alias("hi"), mean_r.alias("mean_residual"))


def fit_line(df: DataFrame, y: str = "y", p: str = "pred") -> DataFrame:
    """M-26: slope and intercept of predicted on actual."""
    return df.agg(F.regr_slope(F.col(p), F.col(y)).alias("slope"), F.regr_intercept(F.col(p), F.col(y)).alias("intercept"))


# M-20: leave-one-out KNN quality ------------------------------------------------------

def zero_filled_strengths(user_tag: DataFrame, users: DataFrame) -> DataFrame:
    """(user, tag, s) for all 20 tags (generator, no join fan-out)."""
    grid = users.select("user_key").distinct().withColumn("tag", F.explode(F.array(*[F.lit(t) for t in TAGS])))
    return grid.join(user_tag.select("user_key", "tag", F.col("tag_strength").alias("s")),
                     ["user_key", "tag"], "left").fillna(0.0, subset=["s"])


def avg_rank(partition: list[str], value: str) -> Column:
    """W-10: ascending rank with ties averaged; values are compared rounded
    to 1e-9 so summation order cannot split a true tie."""
    v = F.round(F.col(value), 9)
    w = Window.partitionBy(*partition).orderBy(v)
    ties = Window.partitionBy(*partition, v)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def loo_user_metrics(peers: DataFrame, user_tag: DataFrame, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """Per target: weak-set Jaccard and recall vs the peer centroid (A-35,
    U-3), tag MSE, Spearman of tag strengths (W-10 ranks + Pearson).  The
    peers are the leave-one-out neighbours (self is never a peer)."""
    s = zero_filled_strengths(user_tag, user_tag)
    cent = (peers.select("target_key", "peer_key")
            .join(s.withColumnRenamed("user_key", "peer_key"), "peer_key")
            .groupBy("target_key", "tag").agg(F.avg("s").alias("c")))
    t = s.withColumnRenamed("user_key", "target_key").join(cent, ["target_key", "tag"])
    t = t.withColumn("rt", avg_rank(["target_key"], "s")).withColumn("rc", avg_rank(["target_key"], "c"))
    tw, cw = F.col("s") < threshold, F.col("c") < threshold   # F-30 weak-tag predicate
    per = t.groupBy("target_key").agg(
        F.count_if(tw & cw).alias("n_inter"), F.count_if(tw | cw).alias("n_union"), F.count_if(tw).alias("n_tweak"),
        F.avg((F.col("s") - F.col("c")) * (F.col("s") - F.col("c"))).alias("tag_mse"),
        F.when((F.stddev_pop("rt") > 0) & (F.stddev_pop("rc") > 0), F.corr("rt", "rc")).alias("tag_spearman"),
    )
    return per.select(
        "target_key",
        F.when(F.col("n_union") > 0, F.col("n_inter") / F.col("n_union")).alias("weakness_jaccard"),
        F.when(F.col("n_tweak") > 0, F.col("n_inter") / F.col("n_tweak")).alias("weakness_recall"),
        "tag_mse", "tag_spearman",
    )


def loo_summary(per_user: DataFrame, k: int, threshold: float = WEAK_THRESHOLD) -> DataFrame:
    """M-20 summary: means that skip undefined values."""
    return per_user.agg(
        F.avg("weakness_jaccard").alias("weakness_jaccard"),
        F.avg("weakness_recall").alias("weakness_recall"),
        F.avg("tag_mse").alias("tag_mse"),
        F.avg("tag_spearman").alias("tag_spearman"),
        F.count(F.lit(1)).alias("n_evaluated"),
    ).withColumn("k", F.lit(k)).withColumn("weak_threshold", F.lit(threshold))


# M-22 -----------------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted), row-normalised share, and accuracy."""
    c = df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    row_tot = F.sum("n").over(Window.partitionBy(actual))
    return c.withColumn("row_share", F.col("n") / row_tot)


def stratified_folds(df: DataFrame, key: str, label: str, n: int = 5) -> DataFrame:
    """W-11: class-stratified folds: inside each label, rows ordered by the
    md5 hash of the key are dealt round-robin into n folds.  The per-label
    row number comes from one distributed global rank minus the label's
    first rank (no window over a whole class)."""
    from .ordered import global_rank

    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    ranked = global_rank(df.withColumn("_h", h), [F.col(label), F.col("_h"), F.col(key)])
    first = ranked.groupBy(label).agg(F.min("global_rank").alias("_first"))
    return ranked.join(first, label).withColumn(
        "fold", F.pmod(F.col("global_rank") - F.col("_first"), F.lit(n)).cast("int")).drop("_h", "_first", "global_rank")


def shuffled_folds(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """W-11: shuffled folds = md5 hash bucket of the key."""
    return df.withColumn("fold", hash_bucket(F.col(key).cast("string"), n))
