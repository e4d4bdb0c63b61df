"""Joins with hub keys: the same rows as a plain join, spread evenly over the tasks."""

import statistics

import pytest
from pyspark.sql import functions as F

from peerskill.operators import recommend as R
from peerskill.operators.skew import salted_join


@pytest.fixture()
def many_tasks(spark):
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tables(spark, shape):
    """Peers and solved items in which peer 0 makes about 30 % of all pairs: many targets, or many items."""
    targets, items = (6000, 30) if shape == "targets" else (3, 60_000)
    peers = spark.range(20_000).selectExpr("id as target_key", "1 + id % 700 as peer_key").union(
        spark.range(targets).selectExpr("100000 + id as target_key", "0L as peer_key"))
    solved = spark.range(700).selectExpr("1 + id as peer_key", "explode(sequence(0, 20)) as item").selectExpr("peer_key", "cast(item as string) as item").union(
        spark.range(items).selectExpr("0L as peer_key", "cast(id as string) as item"))
    return peers, solved


@pytest.mark.parametrize("shape", ["targets", "items"])
def test_a_hub_is_spread(spark, many_tasks, shape):
    peers, solved = tables(spark, shape)
    joined = salted_join(peers, solved, "peer_key", "target_key", "item")
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    plain = peers.join(solved, "peer_key")
    hub = plain.where("peer_key = 0").count() / plain.count()
    assert 0.25 < hub < 0.35
    assert len(sizes) == 16 and max(sizes) <= 3 * statistics.median(sizes), sizes
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("target_key", "peer_key", "item").cast("decimal(38,0)"))).first()
    assert digest(joined.select("target_key", "peer_key", "item")) == digest(plain.select("target_key", "peer_key", "item"))


def test_pool_with_a_hub_equals_plain_sums(spark, many_tasks):
    peers, solved = tables(spark, "targets")
    peers = peers.withColumn("similarity", (F.col("target_key") % 7 + 1).cast("double"))
    pairs = solved.select(F.col("peer_key").alias("user_key"), "item", F.lit(1).alias("ever_ac"), F.lit(800).alias("item_rating"))
    items = solved.select("item").distinct().withColumn("item_rating", F.lit(800)).withColumn("tags", F.array(F.lit("dp")))
    got = R.collaborative_candidates(peers, pairs, items, limit=1000)
    want = peers.join(solved, "peer_key").join(solved.withColumnRenamed("peer_key", "target_key"), ["target_key", "item"], "left_anti")
    want = want.groupBy("target_key", "item").agg(F.sum(F.col("similarity") / 100).alias("w"))
    both = got.join(want, ["target_key", "item"], "full")
    assert both.count() == want.count() and both.where("collab_score is null or w is null or abs(collab_score - w) > 1e-9").count() == 0


def test_empty_and_null_keys(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "target_key long, peer_key long")
    right = spark.createDataFrame([(None, "a"), (5, "b")], "peer_key long, item string")
    assert [tuple(r) for r in salted_join(left, right, "peer_key", "target_key", "item").select("target_key", "item").collect()] == [(2, "b")]
    assert salted_join(left.limit(0), right, "peer_key", "target_key", "item").count() == 0


def test_pool_is_shuffled_once_by_target(spark):
    peers = spark.createDataFrame([(1, 2, 100.0), (1, 3, 50.0), (2, 1, 100.0)], "target_key long, peer_key long, similarity double")
    pairs = spark.createDataFrame([(1, "a", 1, 900), (2, "a", 1, 900), (2, "b", 1, 900), (3, "b", 1, 900), (3, "c", 1, 0), (3, "d", 1, 900), (3, "e", 0, 900),
                                   (3, None, 1, 900)], "user_key long, item string, ever_ac int, item_rating int")
    items = spark.createDataFrame([("a", 900, ["x"]), ("b", 900, []), ("c", 0, []), ("e", 900, [])], "item string, item_rating int, tags array<string>")
    pool = R.collaborative_candidates(peers, pairs, items, limit=5)
    assert [tuple(r) for r in pool.orderBy("target_key").select("target_key", "item", "collab_score", "pool_rank", "item_rating", "tags").collect()] == [
        (1, "b", 1.5, 1, 900, [])]  # a is solved by both, c has no rating, d no metadata, e is not solved
    plan = pool._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning(target_key" in x]
    assert len(shuffles) == 1 and "target_key" in shuffles[0] and "item" not in shuffles[0].split("ENSURE")[0].split("REPARTITION")[0]
