"""Sharding by a k-d tree: nodes are split at distributed weighted medians along their widest metadata dimension until leaves reach the
target bytes.  DataFrame functions only.

Each dimension is first replaced by every row's rank in it, found by a range-partitioned sort and a prefix sum, so that widths of unlike
dimensions compare and no two rows tie.  A median is found for all nodes of a level at once: bytes are summed in ``BUCKETS`` ranges of
rank a node, the range that holds the median is cut again, until it is one rank.  Nothing but counts comes to the driver; the tree is a
table with a row per node."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import global_rank
from .common import written

#: Ranges of a node counted in one pass; bytes added to each text's own.
BUCKETS, ROW_BYTES = 1024, 8
_WIDE = "decimal(38,0)"
#: Ranks tie on equal values of a dimension: equal texts then stand together, and a median parts at most one group of them.
TIES = ["text_crc32", "doc_id", "_row"]


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions bytes, script (bytes per 1000 code points), word_length (code points per 1000 blanks)."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumns({"n": F.octet_length("text").cast("long"), "n_chars": F.char_length("text").cast("long"), "n_blanks": F.expr("char_length(text) - char_length(replace(text, ' ', ''))")})
    return t.select(
        "doc_id", (F.col("n") + ROW_BYTES).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.col("n").alias("bytes"),
        F.expr("(1000 * n) div greatest(n_chars, 1)").alias("script"), F.expr("(1000 * n_chars) div (n_blanks + 1)").alias("word_length"),
    )


def medians(rows: DataFrame, dims: list[str], count: int) -> DataFrame:
    """One row per node of ``rows`` with more than one leaf: node, dim (the widest), cut (the last rank that goes left).

    The left side takes leaves div 2 of the node's leaves and as near as possible that share of its bytes."""
    wide = rows.where("leaves > 1").groupBy("node").agg(
        F.max("leaves").alias("leaves"), F.sum("size").alias("total"), *(F.min(f"rank_{d}").alias(f"lo_{d}") for d in dims), *(F.max(f"rank_{d}").alias(f"hi_{d}") for d in dims)
    )
    widest = F.greatest(*(F.col(f"hi_{d}") - F.col(f"lo_{d}") for d in dims))
    pick = lambda of: F.coalesce(*(F.when(F.col(f"hi_{d}") - F.col(f"lo_{d}") == widest, of(i, d)) for i, d in enumerate(dims)))
    goal = F.col("total").cast(_WIDE) * F.expr("leaves div 2")
    cuts = written(wide.select(
        "node", "leaves", goal.alias("goal"), pick(lambda i, d: F.lit(i)).alias("dim"), pick(lambda i, d: F.col(f"lo_{d}")).alias("lo"),
        pick(lambda i, d: F.col(f"hi_{d}")).alias("hi"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("own"),
    ), "kd_cuts")
    for _ in range(max(1, math.ceil(math.log(max(count, 2), BUCKETS) + 1e-9))):
        place = F.element_at(F.array(*(F.col(f"rank_{d}") for d in dims)), F.col("dim") + 1)
        step = F.expr(f"greatest(1, (hi - lo + {BUCKETS}) div {BUCKETS})")
        near = rows.drop("leaves").join(cuts, "node").withColumn("place", place).where("place between lo and hi").withColumn("step", step)
        sums = near.withColumn("bucket", F.expr("(place - lo) div step")).groupBy("node", "bucket").agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(Window.partitionBy("node").orderBy("bucket"))
        sums = sums.withColumn("upto", upto).join(cuts.withColumn("step", step), "node").withColumn("upto", F.col("upto") + F.col("base"))
        first = sums.where(F.col("upto").cast(_WIDE) * F.col("leaves") >= F.col("goal")).groupBy("node").agg(F.min(F.struct("bucket", "s", "upto", "leaves", "goal", "dim", "lo", "hi", "step")).alias("x"))
        lo = F.col("x.lo") + F.col("x.bucket") * F.col("x.step")
        cuts = written(first.select(
            "node", "x.leaves", "x.goal", "x.dim", lo.alias("lo"), F.least(lo + F.col("x.step") - 1, F.col("x.hi")).alias("hi"),
            (F.col("x.upto") - F.col("x.s")).alias("base"), F.col("x.s").alias("own"),
        ), "kd_cuts")
    over = (F.col("base") + F.col("own")).cast(_WIDE) * F.col("leaves") - F.col("goal")
    under = F.col("goal") - F.col("base").cast(_WIDE) * F.col("leaves")
    return cuts.select("node", "dim", F.when(over <= under, F.col("lo")).otherwise(F.col("lo") - 1).alias("cut"))


def kd_shards(rows: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int = 1 << 30) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32 and the columns ``dims`` of any ordered type) with shard and slot (gapless from 0 in a shard).

    There are ``shards`` leaves, or as many as hold ``target_bytes`` each.  Bytes of leaves differ by about a row's size a level; a row
    larger than a leaf stands alone, and its neighbours may stay empty.  Null dimensions rank first.  Rows that are equal in every
    column are interchangeable.  An empty table gives none."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "kd_rows")
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    shards = shards or max(1, math.ceil((total or 0) / target_bytes))
    work = rows
    for d in dims:
        work = global_rank(work, [F.col(c) for c in (d, *TIES)], parts).withColumnRenamed("global_rank", f"rank_{d}")
    work = written(work.withColumns({"node": F.lit(0), "leaves": F.lit(shards)}), "kd_work")
    for _ in range(math.ceil(math.log2(shards)) if count else 0):
        place = F.element_at(F.array(*(F.col(f"rank_{d}") for d in dims)), F.col("dim") + 1)
        right, left = place > F.col("cut"), F.expr("leaves div 2")
        split = work.join(medians(work, dims, count), "node", "left").withColumns({
            "_leaves": F.when(F.col("cut").isNull(), F.col("leaves")).when(right, F.col("leaves") - left).otherwise(left),
            "node": F.when(right, F.col("node") + left).otherwise(F.col("node")),
        })
        work = written(split.drop("dim", "cut", "leaves").withColumnRenamed("_leaves", "leaves"), "kd_work")
    shard = work.drop("leaves", *(f"rank_{d}" for d in dims)).withColumn("shard", F.col("node").cast("int")).drop("node")
    sizes = shard.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("start"))
    ranked = global_rank(shard, [F.col(c) for c in ("shard", "doc_id", "text_crc32", "_row")], parts)
    return ranked.join(starts, "shard").withColumn("slot", F.col("global_rank") - 1 - F.col("start")).drop("global_rank", "start", "_row")


def shard_documents(docs: DataFrame, shards: int | None = 24, target_bytes: int = 1 << 30) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null: the law is not ``key``) of every row of ``docs``.

    Dimensions are figures of the text, so equal texts have equal places and go to one shard, but for the groups that a median parts
    (at most one a median; a group that holds a third of all bytes has to be parted).  Null and empty texts have size 8.  Rows without
    doc_id, repeated rows and ids keep a row each; other columns are ignored."""
    out = kd_shards(metadata(docs), ["bytes", "script", "word_length"], shards, target_bytes)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
