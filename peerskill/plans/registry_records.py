"""Registered queries: served records and their formats (S-7), the self-contained variant's ranking and impact (L-2, F-19, F-24, F-27),
shown impacts (L-5) and the crawl plan over contests (E-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TAG_LABELS
from ..operators import benchmark as B
from ..operators import clean as C
from ..operators import ordered as O
from ..operators import recommend as R
from ..operators import record as RC
from ..session import scratch_path
from ..sources import io as IO
from . import sql_blocks as Q
from .catalog import register
from .jobs import materialize

_BASE = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.TAG_DIM, Q.vectors(), Q.peers()]


def _sink(expr: str, digits: int) -> str:
    return f"round(round(CAST({expr} AS DOUBLE), 9), {digits})"


_TRIED = f"""tried AS (SELECT target_key, tag, {_sink('strength', 1)} AS s, attempted, d.ord FROM bench JOIN tag_dim d USING (tag)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY s, ord) AS up, count(*) OVER (PARTITION BY target_key) AS n FROM tried WHERE attempted > 0)"""


@register("recommendation_record", Q.with_(*_BASE, Q.item_stats(), Q.bench(), Q.recommend(), Q.impact(), _TRIED) + f"""
    SELECT CAST(target_key AS BIGINT) AS target_key, section, CAST(pos AS INTEGER) AS pos, name, round(CAST(value AS DOUBLE), 6) AS value FROM (
      SELECT DISTINCT target_key, 'dataset_size' AS section, 0 AS pos, 'euclidean' AS name, (SELECT count(*) FROM vec) AS value FROM peers
      UNION ALL SELECT target_key, 'num_neighbors', 0, 'neighbors', count(*) FROM peers GROUP BY target_key
      UNION ALL SELECT target_key, 'weak_tag_count', 0, 'tags', count(*) FILTER (WHERE attempted > 0 AND s < 70) FROM tried GROUP BY target_key
      UNION ALL SELECT target_key, 'neighbor', rank, CAST(peer_key AS VARCHAR), distance FROM peers
      UNION ALL SELECT target_key, 'tag', ord, replace(tag, '_', ' '), s FROM tried
      UNION ALL SELECT target_key, 'weakest', up, tag, NULL FROM placed WHERE up <= 5
      UNION ALL SELECT target_key, 'strongest', up - greatest(n - 5, 0), tag, NULL FROM placed WHERE up > n - 5
      UNION ALL SELECT target_key, 'item', rec_rank, item, {_sink('final_score', 4)} FROM recs
      UNION ALL SELECT target_key, 'impact', impact_rank, label, delta_problems FROM imp WHERE delta_problems > 0 AND impact_rank <= 8)""")
def recommendation_record(inp):
    """S-7 / L-4 / L-5 / A-34 / F-10 / F-21 / F-30: the full record of every user written as JSON, read back and told fact by fact."""
    size = inp.vectors().agg(F.count(F.lit(1))).scalar()
    records = RC.recommendation_records(inp.peers(), materialize(inp.spark, inp.peer_benchmark(), "bench"), inp.recommendations(), inp.tag_impact(),
                                        size, inp.settings.knn.metric)
    path = scratch_path(inp.spark, "records")
    IO.write_records(records, path)
    return RC.record_facts(inp.spark.read.schema(RC.RECORD_SCHEMA).json(path))


@register("recommendation_formats", Q.with_(*_BASE) + """ SELECT target_key, rank, CAST(peer_key AS VARCHAR) AS user_handle,
      round(distance, 6) AS distance, peer_key AS listed FROM peers""")
def recommendation_formats(inp):
    """S-7: neighbours written as CSV and as a plain list, both read back and put side by side."""
    path = scratch_path(inp.spark, "formats")
    for fmt in ("csv", "list"):
        IO.write_recommendations(inp.peers(), f"{path}/{fmt}", fmt)
    listed = IO.read_recommendation_list(inp.spark, f"{path}/list").withColumnRenamed("peer_key", "listed")
    return IO.read_recommendation_csv(inp.spark, f"{path}/csv").join(listed, ["target_key", "rank"], "full")


_POOL_300 = Q.recommend().replace("p.similarity / 100.0", "1.0 / p.rank").replace("<= 200", "<= 300")
_LONG = "CASE {} " + " ".join(f"WHEN '{t}' THEN '{name}'" for t, name in TAG_LABELS.items()) + " END"
_VARIANT = f"""med AS (SELECT p.target_key, u.tag, median(u.tag_strength) AS m FROM peers p JOIN user_tag u ON u.user_key = p.peer_key GROUP BY 1, 2),
  vboost AS (SELECT pt.target_key, pt.item, avg((1.0 - coalesce(u.tag_strength, 0.0)) * coalesce(m.m, 0.0)) AS b FROM pool_tags pt
             LEFT JOIN user_tag u ON u.user_key = pt.target_key AND u.tag = pt.tag LEFT JOIN med m ON m.target_key = pt.target_key AND m.tag = pt.tag GROUP BY 1, 2),
  vs AS (SELECT s.target_key, s.item, s.item_rating, solve_score + 0.2 AS match, b, solve_score, round(1.0 + greatest(rating_diff, 0.0) / 400.0 + (1.0 - mean_ts), 9) AS est
         FROM scored s JOIN vboost v ON v.target_key = s.target_key AND v.item = s.item WHERE solve_score BETWEEN -0.2 AND 0.8),
  vr AS (SELECT target_key, item, item_rating, {_sink('solve_score', 3)} AS solve_score, {_sink('match', 3)} AS difficulty_match, {_sink('b', 3)} AS weakness_boost,
           {_sink('0.6 * match + 0.4 * b', 3)} AS final_score, round(est, 2) AS estimated_attempts,
           CASE WHEN est < 1.5 THEN 'easy' WHEN est < 2.5 THEN 'moderate' ELSE 'hard' END AS difficulty_label FROM vs),
  vranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_key ORDER BY weakness_boost DESC, final_score DESC, item) AS INTEGER) AS rec_rank FROM vr)"""


def _features_300(inp):
    pool = R.collaborative_candidates_rr(inp.peers(), inp.pairs_table(), inp.items_table())
    return R.candidate_features(pool, inp.context())


@register("recommendations_variant", Q.with_(*_BASE, _POOL_300, _VARIANT) + f""" SELECT v.target_key, v.item, v.item_rating, solve_score, difficulty_match, weakness_boost,
      final_score, estimated_attempts, difficulty_label, rec_rank,
      array_to_string([{_LONG.format('t')} FOR t IN i.tags], ', ') AS tag_labels FROM vranked v JOIN items i ON i.item = v.item WHERE rec_rank <= 50""")
def recommendations_variant(inp):
    """L-2 / F-19 / F-27 / A-14: the variant's 50 items of every user: pool of 300 by reciprocal ranks, median peer strengths, match = score + 0.2."""
    med = B.peer_medians_variant(inp.peers(), inp.user_tag_table()).select("target_key", "tag", F.col("med_strength").alias("peer_strength"))
    return R.prioritise_variant(_features_300(inp), med).withColumn("tag_labels", F.array_join("tag_labels", ", "))


@register("tag_impact_variant", Q.with_(*_BASE, _POOL_300, Q.impact()) + f""" SELECT c.target_key, c.tag, {_sink('coalesce(u.tag_strength, 0.0)', 3)} AS strength,
      CAST(c.raw_delta AS INTEGER) AS delta_problems, CAST(c.raw_delta * 5 AS INTEGER) AS estimated_rating_gain, {_LONG.format('c.tag')} AS label,
      CAST(row_number() OVER (PARTITION BY c.target_key ORDER BY c.raw_delta DESC, d.ord) AS INTEGER) AS impact_rank
    FROM cnt c JOIN tag_dim d ON d.tag = c.tag LEFT JOIN user_tag u ON u.user_key = c.target_key AND u.tag = c.tag""")
def tag_impact_variant(inp):
    """F-24 / F-27: the variant's signed impact, five points an item, with long labels."""
    return R.counterfactual_impact(_features_300(inp), inp.context(), signed=True)


@register("tag_impact_top8", Q.with_(*_BASE, Q.recommend(), Q.impact())
          + " SELECT target_key, tag, label, delta_problems, estimated_rating_gain, impact_rank FROM imp WHERE delta_problems > 0 AND impact_rank <= 8")
def tag_impact_top8(inp):
    """L-5: the shown impacts: tags that gain items, the first eight of a user."""
    return R.top_impacts(inp.tag_impact()).select("target_key", "tag", "label", "delta_problems", "estimated_rating_gain", "impact_rank")


_DAY = 86400
_LISTS = 64
_CONTESTS = f"""
  log AS (SELECT user_key, CAST(floor(epoch(submitted_at)) AS BIGINT) AS s FROM att_order),
  now AS (SELECT max(s) AS t FROM log),
  contest AS (SELECT DISTINCT s // {_DAY} AS c, (s // {_DAY}) * {_DAY} AS start_second, ((s // {_DAY}) % 3 + 1) * 21600 AS dur FROM log),
  recent AS (SELECT * FROM contest, now WHERE c % 7 <> 0 AND start_second + dur <= t AND start_second + dur >= t - 7 * {_DAY}),
  rated AS (SELECT CAST(c_custkey AS BIGINT) AS user_key FROM customer WHERE c_custkey % 19 <> 3 AND 900 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 1700 BETWEEN 900 AND 3500),
  parti AS (SELECT DISTINCT user_key FROM log JOIN recent r ON r.c = s // {_DAY} AND s >= start_second AND s < start_second + dur WHERE user_key IN (SELECT user_key FROM rated)),
  flagged AS (SELECT user_key, CASE WHEN user_key IN (SELECT user_key FROM log, now WHERE s < t - 14 * {_DAY}) THEN 0 ELSE 1 END AS is_new FROM parti),
  dealt AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY is_new DESC, user_key) - 1) / (count(*) OVER () // {_LISTS} + 1)) AS INTEGER) AS chunk FROM flagged)"""


@register("crawl_plan_contests", Q.with_(Q.ATT_ORDER, _CONTESTS) + f""" SELECT CAST(g.i AS INTEGER) AS chunk, count(d.user_key) AS n_users,
      CAST(coalesce(sum(d.is_new), 0) AS BIGINT) AS n_new, coalesce(min(d.user_key), 0) AS first_user, coalesce(max(d.user_key), 0) AS last_user,
      (SELECT count(*) FROM dealt WHERE is_new = 0) AS known_users
    FROM range({_LISTS}) g(i) LEFT JOIN dealt d ON d.chunk = g.i GROUP BY g.i""")
def crawl_plan_contests(inp):
    """E-7 / P-17 / P-18 / J-16 / J-11 / W-12 / S-11: daily contests of the log, those finished in its last seven days, their rated
    participants, new ones (no attempt before the last 14 days) first, dealt into 64 lists that are padded; lists and known users are read back."""
    spark = inp.spark
    att = inp.att_order().select("user_key", F.unix_seconds(F.col("submitted_at").cast("timestamp")).alias("second"))
    now = att.agg(F.max("second")).scalar()
    day = F.floor(F.col("second") / _DAY).cast("long")
    contests = att.select(day.alias("contest")).distinct().select(
        "contest", (F.col("contest") * _DAY).alias("start_second"), ((F.col("contest") % 3 + 1) * 21600).alias("duration_seconds"))
    ended = (F.col("contest") % 7 != 0) & (F.col("start_second") + F.col("duration_seconds") <= now)
    contests = contests.withColumn("phase", F.when(ended, "FINISHED").otherwise("CODING"))
    recent = C.finished_window(contests, now - 7 * _DAY)
    inside = F.col("second").between(F.col("start_second"), F.col("start_second") + F.col("duration_seconds") - 1)
    users = att.withColumn("contest", day).join(recent, "contest").filter(inside).select("user_key").distinct()
    rated = C.rating_range(inp.ratings(), "cf_rating", 900, 3500).select("user_key")
    known = att.filter(F.col("second") < now - 14 * _DAY).select("user_key").distinct().withColumn("_known", F.lit(1))
    flagged = users.join(rated, "user_key", "left_semi").join(known, "user_key", "left").select(
        "user_key", F.when(F.col("_known").isNull(), 1).otherwise(0).alias("is_new"))
    chunks = O.assign_chunks(flagged, _LISTS).select("user_key", "is_new", "chunk")
    path = scratch_path(spark, "crawl_lists")
    IO.write_crawl_lists(chunks, path)
    lists = spark.read.schema("user_key long, is_new int, chunk int").json(f"{path}/lists")
    ends = lists.groupBy("chunk").agg(F.min("user_key").alias("first_user"), F.max("user_key").alias("last_user"))
    n_known = spark.read.text(f"{path}/known").agg(F.count(F.lit(1))).scalar()
    return O.chunk_manifest(lists, _LISTS).join(ends, "chunk", "left").fillna(0, ["first_user", "last_user"]).withColumn("known_users", n_known)
