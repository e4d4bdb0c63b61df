"""Helpers shared by the operators of this subpackage: written intermediates, Arrow batch sizes, clean inputs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

#: Most rows of a table in one Arrow batch to Python; keeps a batch of whole texts at a few MB.
ROWS_PER_BATCH = 1024


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Lower Spark's Arrow batch size to ``rows``, so that Python workers hold few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for the jobs run inside; afterwards the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` under the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of ``docs`` and the columns ``more``; other columns, whatever their names, are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def crc_mod(column: str, n: int):
    """crc32(column as text) mod n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def only_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id (null counts as equal to null) and text are those of a row of ``rows`` (doc_id, text_hash)."""
    keys = rows.select(F.col("doc_id").alias("_key_id"), F.col("text_hash").alias("_key_hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_key_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_key_hash"))
    return docs.hint("merge").join(keys, same, "left_semi")
