"""Adapters that turn the TESTDATA tables into attempt logs and profiles.

``att_scale``  lineitem x orders  -> attempts (aggregates, joins, KNN, recommend)
``att_order``  events              -> attempts with a unique, total order
``profiles``   customer            -> user profiles

Every adapter is a narrow projection (plus one equi-join for ``att_scale``).
Attempt rows carry the item key and rating; the tag arrays live in the item
dimension (``items``), built from the distinct item keys actually present,
so tags are computed once per item rather than once per attempt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RANK_ORDER, TAGS

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def item_rating_col(item_key: Column) -> Column:
    # 0 = unrated, otherwise 800..3500
    return F.when(item_key % 25 == 0, F.lit(0)).otherwise(F.lit(800) + F.lit(100) * (item_key % 28)).cast("int")


def item_tags_col(item_key: Column) -> Column:
    """Active tags of an item, in canonical tag order: 3 or 4, or none for one item in 50 (unrated too) and one in 37."""
    flags = [F.when((item_key * 7 + i * 3) % 11 < 2, F.lit(t)) for i, t in enumerate(TAGS)]
    untagged = (item_key % 50 == 0) | (item_key % 37 == 5)
    return F.when(untagged, F.array().cast("array<string>")).otherwise(F.filter(F.array(*flags), lambda x: x.isNotNull()))


def _attempt_columns(user_key: Column, item_key: Column, verdict: Column, ts: Column, attempt_id: Column) -> list[Column]:
    is_ac = (verdict == "OK").cast("tinyint")
    is_tle = (verdict == "TIME_LIMIT_EXCEEDED").cast("tinyint")
    is_mle = (verdict == "MEMORY_LIMIT_EXCEEDED").cast("tinyint")
    is_wa = verdict.isin("WRONG_ANSWER", "TIME_LIMIT_EXCEEDED", "MEMORY_LIMIT_EXCEEDED").cast("tinyint")
    return [
        user_key.cast("bigint").alias("user_key"),
        F.concat(F.lit("I_"), item_key.cast("string")).alias("item"),
        item_key.cast("int").alias("item_key"),
        item_rating_col(item_key).alias("item_rating"),
        verdict.alias("verdict"),
        F.coalesce(is_ac, F.lit(0).cast("tinyint")).alias("is_ac"),
        F.coalesce(is_wa, F.lit(0).cast("tinyint")).alias("is_wa"),
        F.coalesce(is_tle, F.lit(0).cast("tinyint")).alias("is_tle"),
        F.coalesce(is_mle, F.lit(0).cast("tinyint")).alias("is_mle"),
        ts.alias("submitted_at"),
        attempt_id.cast("bigint").alias("attempt_id"),
    ]


def items(attempts: DataFrame) -> DataFrame:
    """Item dimension (item, item_key, item_rating, tags) of the items present
    in an attempt log: one partial/final distinct on item_key, then per-item
    columns."""
    keys = attempts.select("item", "item_key").distinct()
    k = F.col("item_key")
    return keys.select("item", "item_key", item_rating_col(k).alias("item_rating"), item_tags_col(k).alias("tags"))


def att_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per lineitem row; user = order customer, item = part.

    ``attempt_id`` (orderkey*16 + linenumber) is a tie-break, not a unique key:
    (orderkey, linenumber) repeats in this data."""
    return att_scale_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def att_scale_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The att_scale mapping over given lineitem / orders DataFrames (batch or
    streaming lineitem joined to static orders)."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
    o = orders.select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    verdict = (
        F.when(rf == "A", "OK")
        .when((rf == "N") & (ls == "O"), "OK")
        .when((rf == "N") & (ls == "F"), "WRONG_ANSWER")
        .when((rf == "R") & (ls == "F"), "TIME_LIMIT_EXCEEDED")
        .when((rf == "R") & (ls == "O"), "COMPILATION_ERROR")
    )
    return j.select(
        *_attempt_columns(
            F.col("o_custkey"),
            F.col("l_partkey"),
            verdict,
            F.col("l_shipdate"),
            F.col("l_orderkey") * 16 + F.col("l_linenumber"),
        )
    )


def att_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per event; (submitted_at, attempt_id) is a total order."""
    return att_order_from(table(spark, sf_dir, "events"))


def att_order_from(events: DataFrame) -> DataFrame:
    """The att_order mapping over a given events DataFrame (batch or streaming)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "props")
    et = F.col("event_type")
    verdict = (
        F.when(et == "purchase", "OK")
        .when(et == "error", "WRONG_ANSWER")
        .when(et == "click", "TIME_LIMIT_EXCEEDED")
        .when(et == "view", "MEMORY_LIMIT_EXCEEDED")
        .when(et == "signup", "COMPILATION_ERROR")
    )
    item_key = F.from_json(F.col("props"), "k int").getField("k")
    return ev.select(*_attempt_columns(F.col("user_id"), item_key, verdict, F.col("ts"), F.col("event_id")))


def rank_label(rating: Column) -> Column:
    """Rating ladder label (the eight labels of RANK_ORDER; >= 2400 is grandmaster)."""
    bounds = [1200, 1400, 1600, 1900, 2100, 2300, 2400]
    expr = F.when(rating.isNull(), F.lit(None).cast("string"))
    for b, label in zip(bounds, RANK_ORDER):
        expr = expr.when(rating < b, F.lit(label))
    return expr.otherwise(F.lit(RANK_ORDER[-1]))


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating columns of every customer (activity columns are derived later); one in 19 has none (0)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    rating = (F.lit(900) + F.floor(F.abs(F.col("c_acctbal"))).cast("int") % 1700).cast("int")
    rated = F.col("c_custkey") % 19 != 3
    rating = F.when(rated, rating).otherwise(F.lit(0))
    return c.select(
        F.col("c_custkey").cast("bigint").alias("user_key"),
        rating.alias("cf_rating"),
        F.when(rated, rating + (F.col("c_custkey") % 300).cast("int")).otherwise(F.lit(0)).cast("int").alias("cf_max_rating"),
        rank_label(rating).alias("cf_rank"),
    )


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream over one TESTDATA table (a file stream source needs a
    folder, so the folder is watched with a glob filter on the table file)."""
    schema = table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", 1).parquet(sf_dir))
