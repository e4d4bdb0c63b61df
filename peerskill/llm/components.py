"""Connected components of an edge table by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _forest(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by stars that connect the same nodes (fewer edges before anything is shuffled)."""
    def run(batches):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(p, p)
                x = p
            return x

        def stars():
            got = [(x, r) for x in parent if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([r for _, r in got], pa.int64())], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = root(u), root(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
            if len(parent) > 1_000_000:  # stars of a part connect what its edges did
                yield stars()
                parent.clear()
        yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v.  Large: every larger neighbour of a node links to its least neighbour (itself included); small: every smaller."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "components_least")
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that is reachable, for every node of an edge.  Edges: columns u and v, long, in any order.

    Each step reads and writes tables in the shared folder.  Rounds grow with the logarithm of the longest path."""
    own = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(_forest(own).distinct(), "components_edges")
    state = None
    while True:
        after = written(_star(_star(now, True), False), "components_edges")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        now, state = after, seen
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
