"""Structured Streaming versions of the incremental refresh (T-1, T-2, T-3).

All queries run with ``trigger(availableNow=True)``: they process whatever
is in the source and stop, so a run equals the batch job over all input so
far, in whatever order files and rows arrive (the tests check exactly that).

Each job owns a folder.  A micro-batch is reduced to one row per key and written to ``data/epoch=<id>``, dealt into key buckets; a batch
that runs again after a failure overwrites its own folder.  Every COMPACT_EVERY batches the epochs are merged into a snapshot: the
buckets that they touch are written anew under ``snapshot/v=<n>``, and one file, ``manifest/v=<n>``, then says which folder holds each
bucket and up to which epoch.  That file is the commit: before it the old snapshot and the epochs count, after it the new one, and only
then are the files that it replaces dropped.  A read merges one snapshot and at most COMPACT_EVERY epochs by the same aggregate, however
many batches there were.  Give the same ``path`` again to go on after a restart; without one, a new folder of the shared checkpoint
folder is used.  A result is read lazily from the files as they are when it is asked for: ask again after the next run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators import clean as C
from ..operators import ordered as O
from ..session import drop_path as _drop
from ..session import scratch_path

#: Batches between two snapshots, and key buckets of a job (each is rewritten on its own).
COMPACT_EVERY, BUCKETS = 8, 64
_MANIFEST = "version long, through long, bucket int, folder long"


def _commit(rows: DataFrame, path: str) -> None:
    """Write the manifest: one file, which is there as a whole or not at all."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


class _State:
    """The rows of a job: a snapshot and the epochs since."""

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.keys, self.merge = spark, path, schema, keys, merge
        # empty tables, so that there is something to read before the first batch
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/data/epoch=-1/bucket=0")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/snapshot/v=-1/bucket=0")
        spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{path}/manifest/v=-1")

    def manifest(self) -> tuple[int, int, dict[int, int]]:
        """(version, last epoch in the snapshot, folder of each bucket) of the last commit."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()  # at most BUCKETS rows a version kept
        version = max((r["version"] for r in rows), default=-1)
        last = [r for r in rows if r["version"] == version]
        return version, max((r["through"] for r in last), default=-1), {r["bucket"]: r["folder"] for r in last if r["bucket"] >= 0}

    def _read(self, name: str, folder: str) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(folder, LongType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _epochs(self, through: int) -> DataFrame:
        return self._read("data", "epoch").where(F.col("epoch") > through)

    def _snapshot(self, folders: dict[int, int]) -> DataFrame:
        rows = self._read("snapshot", "v")
        held: Column = reduce(Column.__or__, [(F.col("bucket") == b) & (F.col("v") == v) for b, v in folders.items()], F.lit(False))
        return rows.where(held)  # partition columns: other folders are not read

    def write(self, rows: DataFrame, epoch: int) -> None:
        version, through, folders = self.manifest()
        if epoch <= through:
            return  # committed before a stop, the stream only did not know yet
        names = [f.name for f in self.schema]
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int").alias("bucket")
        rows.select(*names, bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/epoch={epoch}")
        if epoch - through >= COMPACT_EVERY:
            self.compact(version, through, epoch, folders)

    def compact(self, version: int, through: int, epoch: int, folders: dict[int, int]) -> None:
        fresh = self._epochs(through)
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # at most BUCKETS
        names, now = [f.name for f in self.schema], version + 1
        old = self._snapshot({b: v for b, v in folders.items() if b in touched})
        merged = self.merge(old.select(*names).unionByName(fresh.select(*names)))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int").alias("bucket")
        merged.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshot/v={now}")
        held = {**folders, **{b: now for b in touched}}
        _commit(self.spark.createDataFrame([(now, epoch, b, v) for b, v in (held or {-1: -1}).items()], _MANIFEST), f"{self.path}/manifest/v={now}")
        for e in {r["epoch"] for r in self._epochs(-1).where(F.col("epoch") <= epoch).select("epoch").distinct().collect()}:
            _drop(self.spark, f"{self.path}/data/epoch={e}")
        for b in touched & folders.keys():
            _drop(self.spark, f"{self.path}/snapshot/v={folders[b]}/bucket={b}")
        if version >= 0:
            _drop(self.spark, f"{self.path}/manifest/v={version}")

    def rows(self) -> DataFrame:
        _, through, folders = self.manifest()
        names = [f.name for f in self.schema]
        return self.merge(self._snapshot(folders).select(*names).unionByName(self._epochs(through).select(*names)))


def _run(spark: SparkSession, stream: DataFrame, reduce_batch: Callable[[DataFrame, int], DataFrame], merge: Callable[[DataFrame], DataFrame],
         keys: list[str], path: str) -> DataFrame:
    """Run the stream to its end and return the merge of all rows so far.  ``merge`` takes reduced rows or its own results, in any order."""
    schema = reduce_batch(spark.createDataFrame([], stream.schema), -1).schema
    state = _State(spark, path, schema, keys, merge)
    q = (stream.writeStream.foreachBatch(lambda batch, epoch: state.write(reduce_batch(batch, epoch), epoch))
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return state.rows()


# T-1 --------------------------------------------------------------------------

def ingest_dedup(spark: SparkSession, attempts_stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """One row per ``keys`` of all attempts streamed so far (null keys group
    together): a row of the earliest micro-batch that had the key, on ties the
    one with the smallest other columns.  Late rows are kept whatever their
    time, and duplicates are found across batches however far apart."""
    rest = [c for c in attempts_stream.columns if c not in keys]

    def first(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct("_epoch", *[F.col(c) for c in rest])).alias("_b")
        return rows.groupBy(*keys).agg(best).select(*keys, "_b.*")

    rows = _run(spark, attempts_stream, lambda b, epoch: first(b.withColumn("_epoch", F.lit(epoch).cast("long"))), first, keys,
                path or scratch_path(spark, "t1-ingest"))
    return rows.select(*attempts_stream.columns)


# T-2 --------------------------------------------------------------------------

def upsert_newest(existing: DataFrame | None, updates: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Existing table merged with new rows, newest kept per key (W-5 rule)."""
    cols = list(dict.fromkeys(keys + ["submitted_at", "attempt_id"] + payload))
    u = updates.select(*cols)
    merged = u if existing is None else existing.select(*cols).unionByName(u)
    return O.dedup_newest(merged, keys, payload)


def stream_upsert_newest(spark: SparkSession, attempts_stream: DataFrame, keys: list[str],
                         payload: list[str], path: str | None = None) -> DataFrame:
    """T-2: the newest attempt per key of all micro-batches so far; every batch
    is written as its own winners, which the same rule merges."""
    newest = lambda rows: upsert_newest(None, rows, keys, payload)
    return _run(spark, attempts_stream, lambda b, _: newest(b), newest, keys, path or scratch_path(spark, "t2-upsert"))


# T-3 --------------------------------------------------------------------------

def running_user_tag_counts(spark: SparkSession, attempts_stream: DataFrame, items: DataFrame,
                            path: str | None = None) -> DataFrame:
    """The A-4 counters (attempt rows, accepted, rejected per user and tag):
    every micro-batch is written as its own partial counts, at most one row per
    (user, tag), and the counters are their sums."""
    tagged = items.select("item", "tags")

    def partial(batch: DataFrame, _: int) -> DataFrame:
        rows = C.decided(batch).join(tagged, "item")
        return (rows.select("user_key", "is_ac", "is_wa", F.explode("tags").alias("tag")).groupBy("user_key", "tag")
                .agg(F.count(F.lit(1)).alias("total_attempts"), F.sum("is_ac").cast("bigint").alias("ac_count"),
                     F.sum("is_wa").cast("bigint").alias("wa_count")))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_key", "tag").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("total_attempts", "ac_count", "wa_count")])

    return _run(spark, attempts_stream, partial, summed, ["user_key", "tag"], path or scratch_path(spark, "t3-counters"))
