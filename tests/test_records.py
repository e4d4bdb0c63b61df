"""Served records, the variant's ranking, signed impacts and the crawl plan's parts on rows written by hand."""

import json

from pyspark.sql import functions as F

from peerskill.config import TAG_LABELS, TAGS
from peerskill.functions import formulas as fx
from peerskill.operators import clean as C
from peerskill.operators import ordered as O
from peerskill.operators import recommend as R
from peerskill.operators import record as RC
from peerskill.sources import io as IO

_PEERS = "target_key long, peer_key long, rank int, distance double, similarity double, display_similarity double"
_BENCH = "target_key long, tag string, solved long, attempted long, avg_difficulty double, acceptance_rate double, strength double"
_RECS = ("target_key long, rec_rank int, item string, item_rating int, solve_score double, weakness_boost double, final_score double,"
         " estimated_attempts double, difficulty_label string")
_IMPACT = "target_key long, label string, delta_problems int, estimated_rating_gain int, impact_rank int"


def _records(spark, bench, recs=(), impact=()):
    peers = spark.createDataFrame([(1, 3, 2, 0.5, 0.0, 10.0), (1, 2, 1, 0.25, 100.0, 50.0), (2, 1, 1, 0.25, 100.0, 50.0)], _PEERS)
    return RC.recommendation_records(peers, spark.createDataFrame(bench, _BENCH), spark.createDataFrame(list(recs), _RECS),
                                     spark.createDataFrame(list(impact), _IMPACT), F.lit(3), "euclidean")


def test_record_orders_rounds_and_fills(spark, tmp_path):
    strengths = {"dp": 70.04, "greedy": 69.96, "graphs": 10.0, "math": 10.0, "strings": 99.25, "impl": 69.94}
    bench = [(1, t, 1, 2, 1500.04, 0.5, s) for t, s in strengths.items()] + [(1, "fft", 0, 0, 0.0, 0.0, 0.0)]
    recs = [(1, 2, "I_9", 1500, 0.123456, 0.2, 0.55555, None, None), (1, 1, "I_7", 1400, 0.0, 0.3, 0.5, 1.005, "easy")]
    impact = [(1, f"t{i}", 12 - i, 5 * (12 - i), i) for i in range(1, 12)] + [(2, "t", 0, 0, 1)]
    path = str(tmp_path / "records")
    IO.write_records(_records(spark, bench, recs, impact), path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert len(lines) == 2 and {x["target_key"] for x in lines} == {1, 2}
    one, two = sorted(spark.read.schema(RC.RECORD_SCHEMA).json(path).collect(), key=lambda r: r["target_key"])
    assert [n["peer_key"] for n in one["neighbors"]] == [2, 3] and one["num_neighbors"] == 2
    assert tuple(one["metadata"]) == ("euclidean", 3)
    # 69.96 is shown as 70.0 and so is not weak; equal strengths keep the vocabulary's order; the untried tag is in neither list
    assert one["weakest_tags"][:3] == ["graphs", "math", "impl"]
    assert one["weakest_tags"][3:] == ["dp", "greedy"] and one["strongest_tags"] == ["math", "impl", "dp", "greedy", "strings"]
    assert one["weak_tag_count"] == 3
    assert {t["tag"]: t["strength"] for t in one["tag_strengths"]} == {"dp": 70.0, "greedy": 70.0, "graphs": 10.0, "math": 10.0, "strings": 99.3, "impl": 69.9, "fft": 0.0}
    assert [(i["item"], i["solve_score"], i["final_score"], i["estimated_attempts"]) for i in one["recommended_items"]] == [
        ("I_7", 0.0, 0.5, 1.01), ("I_9", 0.1235, 0.5556, None)]
    assert [g["impact_rank"] for g in one["tag_impact"]] == list(range(1, 9))
    assert two["tag_strengths"] == [] and two["weakest_tags"] == [] and two["recommended_items"] == [] and two["tag_impact"] == [] and two["weak_tag_count"] == 0


def test_facts_tell_every_list(spark):
    facts = RC.record_facts(_records(spark, [(1, "dp", 1, 2, 1.0, 0.5, 50.0)]))
    got = {(r["target_key"], r["section"], r["pos"], r["name"]): r["value"] for r in facts.collect()}
    assert got[(1, "neighbor", 2, "3")] == 0.5 and got[(1, "tag", 1, "dp")] == 50.0 and got[(1, "weakest", 1, "dp")] is None
    assert got[(1, "weak_tag_count", 0, "tags")] == 1.0 and got[(2, "weak_tag_count", 0, "tags")] == 0.0 and got[(2, "dataset_size", 0, "euclidean")] == 3.0


def test_records_of_no_peers_are_empty(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert RC.recommendation_records(empty(_PEERS), empty(_BENCH), empty(_RECS), empty(_IMPACT), F.lit(0), "cosine").count() == 0


def test_long_labels_and_sink_rounding(spark):
    df = spark.createDataFrame([(t,) for t in TAGS] + [("other",), (None,)], "t string").select("t", fx.long_tag_label(F.col("t")).alias("l"))
    assert {r["t"]: r["l"] for r in df.collect()} == {**TAG_LABELS, "other": "other", None: None}
    noisy = spark.createDataFrame([(0.1 + 0.2 - 0.05,), (62.25,)], "x double").select(fx.at_sink(F.col("x"), 1).alias("r"))
    assert [r["r"] for r in noisy.collect()] == [0.3, 62.3]


def _scored(df):
    return df.withColumn("solve_score", F.col("rating_diff"))


def _attempts(df):
    return df.withColumn("attempts_raw", F.col("tag_coverage"))


def test_variant_rounds_before_it_orders_and_keeps_n(spark):
    rows = [(1, "a", 1200, ["dp"], {"dp": 0.5}, 0.8, 1.499), (1, "b", 1200, ["dp"], {"dp": 0.5}, 0.8001, 1.0), (1, "c", 1200, ["dp"], {"dp": 0.5}, 0.1, 2.4999),
            (1, "d", 1200, ["dp", "fft"], {"dp": 0.5}, 0.1, 2.5), (1, "e", 1200, [], {"dp": 0.5}, 0.1, 1.0), (1, "f", 1200, ["dp"], {"dp": 0.5}, 0.1004, 1.0)]
    feats = spark.createDataFrame(rows, "target_key long, item string, item_rating int, tags array<string>, smap map<string,double>, rating_diff double, tag_coverage double")
    med = spark.createDataFrame([(1, "dp", 0.8)], "target_key long, tag string, peer_strength double")
    out = R.prioritise_variant(feats, med, keep=3, success_scorer=_scored, attempts_scorer=_attempts).orderBy("rec_rank").collect()
    # b is outside the sweet spot, e has no tags; c and f have equal rounded scores, so the item decides; d has half the boost and is fourth
    assert [r["item"] for r in out] == ["a", "c", "f"]
    assert [r["difficulty_match"] for r in out] == [1.0, 0.3, 0.3] and [r["weakness_boost"] for r in out] == [0.4] * 3
    assert [r["difficulty_label"] for r in out] == ["easy", "moderate", "easy"] and out[0]["tag_labels"] == ["Dynamic Programming"]


def test_signed_impact_keeps_losses(spark):
    rows = [(1, "a", 1000, ["dp"], {"dp": 0.5}, 1200, 0), (1, "b", 1200, ["fft"], {"dp": 0.5}, 1200, 0)]
    feats = spark.createDataFrame(rows, "target_key long, item string, item_rating int, tags array<string>, smap map<string,double>, cf_rating int, num_solved int")
    feats = feats.select(*feats.columns, (F.col("item_rating") - F.col("cf_rating")).cast("double").alias("rating_diff"),
                         F.when(F.col("item") == "a", 0.5).otherwise(0.0).alias("mean_tag_strength"))
    ctx = spark.createDataFrame([(1, {"dp": 0.5})], "target_key long, smap map<string,double>")
    by = {s: {r["tag"]: (r["delta_problems"], r["estimated_rating_gain"]) for r in R.counterfactual_impact(feats, ctx, signed=s).collect()} for s in (True, False)}
    assert by[True]["dp"] == (-1, -5) and by[False]["dp"] == (0, 0) and len(by[True]) == 20  # 0.8 goes to 1.0 and leaves the sweet spot


def test_impact_reads_the_pool_once(spark):
    """An item without tags still gives its target a table, a tag named twice counts twice, and the feature frame is planned once."""
    rows = [(1, "a", 1000, ["dp", "dp"], {"dp": 0.0}, 1200, 0), (2, "b", 1000, [], {"dp": 0.3}, 1200, 0), (3, "c", 1000, None, {}, 1200, 0), (None, "d", 1000, ["dp"], {}, 1200, 0)]
    feats = spark.createDataFrame(rows, "target_key long, item string, item_rating int, tags array<string>, smap map<string,double>, cf_rating int, num_solved int")
    feats = feats.select(*feats.columns, F.lit(1100.0).alias("rating_diff"), F.lit(0.0).alias("mean_tag_strength"))  # -1.0: outside the sweet spot
    ctx = spark.createDataFrame([(1, {"dp": 0.0}), (2, {"dp": 0.3}), (3, {}), (4, {})], "target_key long, smap map<string,double>")
    out = R.counterfactual_impact(feats.repartition(2, "item"), ctx)
    got = {(r["target_key"], r["tag"]): (r["delta_problems"], r["strength"], r["impact_rank"]) for r in out.collect()}
    assert {k for k, _ in got} == {1, 2, 3} and len(got) == 60
    assert got[1, "dp"] == (2, 0.0, 1) and all(v[0] == 0 for k, v in got.items() if k != (1, "dp")) and got[2, "dp"][1] == 0.3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1, plan


def test_finished_window_and_padded_lists(spark):
    contests = spark.createDataFrame([(1, "FINISHED", 100, 50), (2, "FINISHED", 100, 49), (3, "CODING", 500, 50), (4, "FINISHED", None, 150), (5, "FINISHED", 150, None), (6, None, 500, 1)],
                                     "contest long, phase string, start_second long, duration_seconds long")
    assert {r["contest"] for r in C.finished_window(contests, F.lit(150)).collect()} == {1, 4, 5}
    users = spark.createDataFrame([(k, k % 2) for k in range(7)], "user_key long, is_new int")
    dealt = O.assign_chunks(users, 5)
    assert [(r["chunk"], r["n_users"], r["n_new"]) for r in O.chunk_manifest(dealt, 5).orderBy("chunk").collect()] == [(0, 2, 2), (1, 2, 1), (2, 2, 0), (3, 1, 0), (4, 0, 0)]
    assert O.chunk_manifest(dealt.limit(0), 3).agg(F.sum("n_users")).first()[0] == 0


def test_known_users_and_formats_come_back(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "user_key long, is_new int, chunk int")
    IO.write_crawl_lists(chunks, str(tmp_path / "c"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "c/known")).collect()} == {"2", "3"}
    peers = spark.createDataFrame([(1, 2, 1, 0.1 + 0.2, 1.0, 1.0)], _PEERS)
    IO.write_recommendations(peers, str(tmp_path / "csv"), "csv")
    IO.write_recommendations(peers, str(tmp_path / "list"), "list")
    assert tuple(IO.read_recommendation_csv(spark, str(tmp_path / "csv")).first()) == (1, 1, "2", 0.1 + 0.2)
    assert tuple(IO.read_recommendation_list(spark, str(tmp_path / "list")).first()) == (1, 1, 2)
