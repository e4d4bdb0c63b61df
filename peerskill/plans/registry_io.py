"""Registered source / sink jobs: each writes real files from the given tables
to the shared checkpoint folder and reads them back through the readers
(S-1..S-11, E-5, E-7)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..config import TAGS
from ..operators import clean as C
from ..operators import ordered as O
from ..session import scratch_path
from ..sources import io as IO
from ..sources import testdata as td
from . import refresh as RF
from . import sql_blocks as Q
from .catalog import register, rounded_select


@register("raw_records_flatten", Q.with_(Q.ATT_SCALE) + """ SELECT CAST(user_key AS VARCHAR) AS handle, CAST(k_ AS VARCHAR) || '_A' AS item,
      item_rating, is_ac, is_wa, is_tle, is_mle, CAST(floor(epoch(submitted_at)) AS BIGINT) AS submitted_epoch, attempt_id,
      array_to_string(tags, ',') AS tags_csv
    FROM (SELECT *, item_key AS k_ FROM att_scale) WHERE item_rating > 0""")
def raw_records_flatten(inp):
    """S-5 / P-1..P-5 / F-33 / J-14: nested JSON dumps written from the attempt
    log, read back with an explicit schema, flattened (rows without rating
    dropped) and completed from the item catalogue."""
    a = td.att_scale(inp.spark, inp.sf_dir).join(inp.items().select("item", "tags"), "item")
    path = scratch_path(inp.spark, "raw_records")
    IO.write_raw_records(a, path)
    flat = IO.flatten_raw_records(inp.spark.read.schema(IO.RAW_RECORD_SCHEMA).json(path))
    # J-14: the catalogue (item dimension, keyed like the records) wins over embedded fields
    cat = inp.items().filter(F.col("item_rating") > 0).select(
        F.concat(F.col("item_key").cast("string"), F.lit("_A")).alias("item"), "item_rating", "tags")
    flat = IO.catalogue_fallback(flat, cat)
    return flat.select("handle", "item", "item_rating", "is_ac", "is_wa", "is_tle", "is_mle",
                       F.unix_seconds("submitted_at").alias("submitted_epoch"), "attempt_id",
                       F.array_join("tags", ",").alias("tags_csv"))


_WIDE_COLS = RF.WIDE
_MERGED = """ (SELECT *, row_number() OVER (PARTITION BY handle, problem_id, submitted_at
                                   ORDER BY is_ac DESC, is_wa DESC, is_tle DESC, is_mle DESC) AS rn
      FROM (SELECT CAST(user_key AS VARCHAR) AS handle, item AS problem_id, item AS problem_name,
                   CAST(item_rating AS DOUBLE) AS problem_rating, is_ac, is_wa, is_tle, is_mle,
                   CAST(floor(epoch(submitted_at)) AS BIGINT) AS submitted_at, tags,
                   """ + ", ".join(f"CAST(list_contains(tags, '{t}') AS TINYINT) AS tag_{t}" for t in TAGS) + """ FROM att_order))
    WHERE rn = 1 AND problem_rating > 0"""


def _weekly_chunks(inp, base: str) -> list[str]:
    """An existing dataset (a quarter of the attempt log) and three wide CSV chunks under ``base`` (one with the old
    ``tag_implementation`` column name, one with unclean handles), an unreadable chunk and one that is not there."""
    spark = inp.spark
    a = td.att_order(spark, inp.sf_dir).join(inp.items_order().select("item", "tags"), "item")
    wide = IO.attempts_to_wide(a)
    part = F.pmod(F.col("submitted_at"), F.lit(4))
    wide.filter(part == 3).write.parquet(f"{base}/existing")
    for i in range(3):
        c = wide.filter(part == i)
        if i == 1:
            c = c.withColumn("handle", F.concat(F.lit(" =@"), "handle")).unionByName(c.withColumn("handle", F.lit("=#NAME?")))
        if i == 2:
            c = c.withColumnRenamed("tag_impl", "tag_implementation")
        c.write.option("header", True).csv(f"{base}/chunk_{i}")
    spark.createDataFrame([("not,a,valid\x00chunk",)], "value string").write.text(f"{base}/chunk_3")
    return [f"{base}/chunk_{i}" for i in range(5)]


@register("chunk_merge_refresh", Q.with_(Q.ATT_ORDER) + " SELECT " + ", ".join(_WIDE_COLS) + " FROM" + _MERGED)
def chunk_merge_refresh(inp):
    """E-5 / S-4 / P-14 / P-15 / U-1 / W-5 / P-13: the weekly chunks merged with the existing dataset: handles cleaned,
    newest row kept per (handle, item, time), unrated dropped, all columns kept."""
    base = scratch_path(inp.spark, "chunks")
    return RF.merge_chunks(inp.spark, _weekly_chunks(inp, base), f"{base}/existing")


_REFRESHED = Q.with_(Q.ATT_ORDER, "mrg AS (SELECT CAST(handle AS BIGINT) AS user_key, problem_id AS item, CAST(problem_rating AS INTEGER) AS item_rating, tags,"
                     " is_ac, CAST(greatest(is_wa, is_tle, is_mle) AS TINYINT) AS is_wa, submitted_at, 0 AS attempt_id FROM" + _MERGED
                     + " AND (is_ac <> 0 OR greatest(is_wa, is_tle, is_mle) <> 0))", Q.profiles("mrg"), Q.user_tag("mrg"))


def _refreshed(inp):
    """The refresh job over the weekly chunks up to the skill tables, run twice: the second run finds all steps done."""
    base = scratch_path(inp.spark, "refresh")
    chunks = _weekly_chunks(inp, f"{base}/in")
    inp.ratings().select(F.col("user_key").cast("string").alias("handle"), "cf_rating", "cf_max_rating", "cf_rank").write.parquet(f"{base}/ratings")
    for _ in range(2):
        job = RF.refresh(inp.spark, f"{base}/job", chunks, f"{base}/in/existing", f"{base}/ratings", models=False)
    return job


@register("refresh_skill_table", _REFRESHED + " SELECT user_key, tag, total_attempts, ac_count, wa_count, round(tag_strength, 6) AS tag_strength, 0 AS steps_run_again FROM user_tag")
def refresh_skill_table(inp):
    """E-5 / E-1 / P-14: the skill table of the restartable refresh job, and how many steps its second run had to do."""
    job = _refreshed(inp)
    return job.read(job.notes["folders"]["skill"], "user_tag").select(
        F.col("user_key").cast("long").alias("user_key"), "tag", "total_attempts", "ac_count", "wa_count", "tag_strength", F.lit(len(job.ran)).alias("steps_run_again"))


@register("refresh_enriched_profiles", _REFRESHED + """ SELECT p.user_key, p.unique_problems_solved, p.total_ac, s.tag AS strongest_tag_computed,
      round(s.tag_strength, 6) AS strongest_tag_score FROM profiles p LEFT JOIN (
        SELECT user_key, tag, tag_strength, row_number() OVER (PARTITION BY user_key ORDER BY tag_strength DESC, list_position(["""
          + ", ".join(f"'{t}'" for t in TAGS) + """], tag)) AS rn FROM user_tag) s ON s.user_key = p.user_key AND s.rn = 1""")
def refresh_enriched_profiles(inp):
    """E-1 / J-2: the enriched profiles that the refresh job has written."""
    job = _refreshed(inp)
    return job.read(job.notes["folders"]["skill"], "enriched").select(
        F.col("user_key").cast("long").alias("user_key"), "unique_problems_solved", "total_ac", "strongest_tag_computed", "strongest_tag_score")


@register("handle_drops", Q.with_(Q.ATT_ORDER) + """ SELECT count(*) + count(*) FILTER (WHERE second % 4 = 1) AS rows,
      count(*) FILTER (WHERE second % 4 = 1) AS dropped FROM (SELECT CAST(floor(epoch(submitted_at)) AS BIGINT) AS second FROM att_order)""")
def handle_drops(inp):
    """P-14: rows read and rows without a usable handle, counted in the pass that merges the weekly chunks."""
    base = scratch_path(inp.spark, "drops")
    chunks, seen = _weekly_chunks(inp, base), Observation()
    RF.merge_chunks(inp.spark, chunks, f"{base}/existing", seen).write.format("noop").mode("overwrite").save()
    got = seen.get
    return inp.spark.createDataFrame([(int(got["rows"]), int(got["dropped"]))], "rows long, dropped long")


_PEER_COLS = ["target_key", "peer_key", "rank", "distance", "similarity", "display_similarity"]


@register("recommendation_json_roundtrip",
          Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.TAG_DIM, Q.vectors(), Q.peers())
          + f" SELECT {rounded_select(_PEER_COLS, _PEER_COLS[3:])} FROM peers")
def recommendation_json_roundtrip(inp):
    """S-7: neighbours written as one nested JSON record per user (plus the CSV
    and list formats), read back and exploded."""
    path = scratch_path(inp.spark, "recs")
    IO.write_recommendations(inp.peers(), f"{path}/json", "json")
    IO.write_recommendations(inp.peers(), f"{path}/csv", "csv")
    IO.write_recommendations(inp.peers(), f"{path}/list", "list")
    return IO.read_recommendations(inp.spark, f"{path}/json").select(*_PEER_COLS)


_UT = ["user_key", "tag", "total_attempts", "ac_count", "wa_count", "tag_strength"]


@register("skill_csv_roundtrip", Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag())
          + f" SELECT {rounded_select(_UT, ['tag_strength'])} FROM user_tag")
def skill_csv_roundtrip(inp):
    """S-6 / S-1: skill table written as fully quoted CSV, read back with explicit types."""
    path = scratch_path(inp.spark, "skill_csv")
    IO.write_quoted_csv(inp.user_tag_table().select(*_UT), path)
    schema = "user_key long, tag string, total_attempts long, ac_count long, wa_count long, tag_strength double"
    return inp.spark.read.schema(schema).option("header", True).csv(path)


@register("crawl_plan", Q.with_(Q.ATT_SCALE, Q.clean(), """
  rated AS (SELECT CAST(c_custkey AS BIGINT) AS user_key FROM customer
            WHERE c_custkey % 19 <> 3 AND 900 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 1700 BETWEEN 900 AND 3500),
  part AS (SELECT DISTINCT user_key FROM att_scale
           WHERE submitted_at >= (SELECT max(submitted_at) FROM att_scale) - INTERVAL 90 DAY
             AND user_key IN (SELECT user_key FROM rated)),
  flagged AS (SELECT user_key, CASE WHEN user_key IN (SELECT user_key FROM clean) THEN 0 ELSE 1 END AS is_new FROM part),
  ranked AS (SELECT *, row_number() OVER (ORDER BY is_new DESC, user_key) AS r, count(*) OVER () AS n FROM flagged)""")
    + " SELECT user_key, is_new, CAST(floor((r - 1) / (n // 3 + 1)) AS INTEGER) AS chunk FROM ranked")
def crawl_plan(inp):
    """E-7 / P-17 / P-18 / J-16 / J-11 / W-12 / S-11: users active in the last
    90 days of the log (``now`` = newest attempt), restricted to rated users in
    900..3500, split new / known against the dataset, dealt into 3 contiguous
    chunks (new first), written as per-chunk work lists and read back."""
    spark = inp.spark
    att = td.att_scale(spark, inp.sf_dir)
    rated = C.rating_range(inp.ratings(), "cf_rating", 900, 3500).select("user_key")
    since = att.agg(F.max("submitted_at")).scalar() - F.expr("INTERVAL 90 DAYS")
    # P-18 + U-5 distinct handles + J-16 semi-join to rated users
    part = C.recent_window(att, "submitted_at", since).select("user_key").distinct().join(rated, "user_key", "left_semi")
    known = inp.pairs_table().select("user_key").distinct().withColumn("_k", F.lit(1))
    flagged = part.join(known, "user_key", "left").select(
        "user_key", F.when(F.col("_k").isNull(), 1).otherwise(0).alias("is_new"))
    chunks = O.assign_chunks(flagged, 3)
    path = scratch_path(spark, "work_lists")
    IO.write_work_lists(chunks.select("user_key", "is_new", "chunk"), path)
    return spark.read.schema("user_key long, is_new int, chunk int").json(path).select("user_key", "is_new", "chunk")


@register("filtered_scan_by_users", Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles()) + """ SELECT a.user_key, count(*) AS n_attempts,
      CAST(sum(a.is_ac) AS BIGINT) AS n_ac FROM att_scale a
    WHERE a.user_key IN (SELECT user_key FROM profiles WHERE cf_rating >= 1600 AND cf_rating < 1900)
    GROUP BY a.user_key""")
def filtered_scan_by_users(inp):
    """S-2 / P-21 / S-3: profiles written as CSV and read back with the handle
    forced to string, restricted to one rank label ('expert'), and the attempt
    log scanned for exactly those users (semi-join)."""
    spark = inp.spark
    path = scratch_path(spark, "profiles_csv")
    prof = inp.profiles_table().select(F.col("user_key").cast("string").alias("handle"), "cf_rating", "cf_max_rating",
                                       F.col("total_ac").cast("int").alias("total_ac"), "first_try_rate", "cf_rank")
    IO.write_quoted_csv(prof, path)
    experts = IO.read_profiles_csv(spark, path).filter(F.col("cf_rank").isin("expert")).select(
        F.col("handle").cast("long").alias("user_key"))
    rows = IO.filter_by_users(td.att_scale(spark, inp.sf_dir), experts)
    return rows.groupBy("user_key").agg(F.count(F.lit(1)).alias("n_attempts"), F.sum("is_ac").cast("bigint").alias("n_ac"))


@register("variant_ingest", Q.with_(Q.ATT_SCALE, """
  w AS (SELECT user_key, item, item_rating, tags, submitted_at, CAST(verdict = 'OK' AS TINYINT) AS is_ac,
               CAST(verdict <> 'OK' AS TINYINT) AS is_wa FROM att_scale
        WHERE verdict IN ('OK', 'WRONG_ANSWER', 'TIME_LIMIT_EXCEEDED', 'MEMORY_LIMIT_EXCEEDED', 'RUNTIME_ERROR')),
  keep AS (SELECT user_key FROM w GROUP BY user_key HAVING sum(is_ac) >= 30),
  known AS (SELECT DISTINCT user_key FROM w
            WHERE submitted_at < (SELECT max(submitted_at) FROM att_scale) - INTERVAL 1095 DAY)""")
    + """ SELECT user_key, item, coalesce(item_rating, 0) AS item_rating, is_ac, is_wa FROM w
      WHERE user_key IN (SELECT user_key FROM keep) AND len(tags) > 0
        AND (user_key NOT IN (SELECT user_key FROM known)
             OR submitted_at >= (SELECT max(submitted_at) FROM att_scale) - INTERVAL 365 DAY)""")
def variant_ingest(inp):
    """P-4 / P-11 / P-19 / P-23 / P-16 / P-9 (the self-contained variant's
    ingest): verdict whitelist with every non-OK as a failure, strict >= 30 AC
    users, tagged items only, and a conditional history window: users already
    in the dataset snapshot taken three years before the newest attempt keep
    only the last 365 days, users new since that snapshot keep everything."""
    a = td.att_scale(inp.spark, inp.sf_dir).join(inp.items().select("item", "tags"), "item")
    w = C.verdict_whitelist(a)
    w = C.min_activity_filter(w, 30, strict=True)
    w = C.tagged_only(w)
    newest = a.agg(F.max("submitted_at")).scalar()
    known = w.filter(F.col("submitted_at") < newest - F.expr("INTERVAL 1095 DAYS")).select("user_key").distinct()
    since = newest - F.expr("INTERVAL 365 DAYS")
    w = C.conditional_history(w, known, "submitted_at", since)
    w = C.null_to_zero(w, ["item_rating"])
    return C.select_prefixed(w.select("user_key", "item", "item_rating", "is_ac", "is_wa"),
                             ["user_key", "item", "item_rating", "is_ac", "is_wa"])
