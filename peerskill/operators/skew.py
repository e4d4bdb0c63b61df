"""Joins whose keys carry very unequal shares of the pairs (hub peers)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: A key whose pairs exceed the mean of a task by one over this is dealt to several tasks.
CHUNKS_PER_TASK = 8


def salted_join(left: DataFrame, right: DataFrame, key: str, left_by: str, right_by: str) -> DataFrame:
    """Inner join of ``left`` and ``right`` on ``key``.

    The pairs of each key (rows left x rows right) are counted first.  A key with more than a CHUNKS_PER_TASK-th of a task's mean is a
    hub: its left rows are dealt into a parts by ``left_by``, its right rows into b parts by ``right_by``, and each of the a x b cells is
    joined on its own.  Only left rows are split as long as there are enough of them, since each right row is then sent a times.  Hubs are
    at most CHUNKS_PER_TASK x shuffle partitions keys, so their table is broadcast; nothing else is.  Null keys join nothing."""
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    path = scratch_path(spark, "key_loads")
    count(left, "_l").join(count(right, "_r"), key).write.parquet(path)
    loads = spark.read.parquet(path).withColumn("_pairs", F.col("_l") * F.col("_r"))
    total = loads.agg(F.sum("_pairs")).first()[0] or 0
    budget = max(1.0, total / (parts * CHUNKS_PER_TASK))
    cells = F.ceil(F.col("_pairs") / budget)
    hubs = loads.where(F.col("_pairs") > budget).withColumn("_a", F.least("_l", cells)).withColumn("_b", F.least("_r", F.ceil(cells / F.col("_a"))))
    hubs = F.broadcast(hubs.select(key, F.col("_a").cast("int").alias("_a"), F.col("_b").cast("int").alias("_b")))

    def dealt(df: DataFrame, own: str, by: str, own_salt: str, other: str, other_salt: str) -> DataFrame:
        of = df.join(hubs, key, "left").withColumn(own_salt, F.coalesce(F.pmod(F.xxhash64(by), F.col(own)), F.lit(0)).cast("int"))
        return of.withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("_a", "_b")

    joined = dealt(left, "_a", left_by, "_sa", "_b", "_sb").join(dealt(right, "_b", right_by, "_sb", "_a", "_sa"), [key, "_sa", "_sb"])
    return joined.drop("_sa", "_sb")
