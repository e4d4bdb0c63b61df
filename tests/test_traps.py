"""Hand-made micro tables for the semantic traps."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from peerskill.operators import benchmark as B
from peerskill.operators import clean as C
from peerskill.operators import ordered as O
from peerskill.operators import runlog as RL
from peerskill.operators import skill as S
from peerskill.sources import io as IO


def test_handle_cleaning_v24(spark):
    rows = [("  =alice ",), ("#NAME?",), ("=#NAME?",), (None,), ("",), ("@bob",), ("\tcarol\n",), ("+-=",)]
    out = C.clean_handles(spark.createDataFrame(rows, "handle string")).toPandas()
    assert sorted(out["handle"]) == ["alice", "bob", "carol"]


def _att(spark, rows):
    schema = ("user_key long, item string, item_rating int, is_ac tinyint, is_wa tinyint, is_tle tinyint, "
              "is_mle tinyint, submitted_at timestamp, attempt_id long")
    return spark.createDataFrame(rows, schema)


def test_min_activity_keeps_zero_ac_users_v9(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "I_1", 800, 0, 1, 0, 0, t, 1)]                                      # zero AC: survives
    rows += [(2, f"I_{i}", 800, 1, 0, 0, 0, t, 10 + i) for i in range(3)]           # 3 AC < 30: dropped
    rows += [(3, f"I_{i}", 800, 1, 0, 0, 0, t, 100 + i) for i in range(30)]         # 30 AC: kept
    df = _att(spark, rows)
    lenient = {r.user_key for r in C.min_activity_filter(df, 30).select("user_key").distinct().collect()}
    strict = {r.user_key for r in C.min_activity_filter(df, 30, strict=True).select("user_key").distinct().collect()}
    assert lenient == {1, 3}
    assert strict == {3}


def test_dedup_null_keys_and_order_v14(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(1, "I_1", 800, 0, 1, 0, 0, None, 5), (1, "I_1", 800, 1, 0, 0, 0, None, 7),
            (1, "I_1", 800, 0, 1, 0, 0, t1, 1), (1, "I_1", 800, 1, 0, 0, 0, t2, 2)]
    df = _att(spark, rows)
    by_ts = O.dedup_newest(df, ["user_key", "item", "submitted_at"], ["is_ac"]).toPandas()
    assert len(by_ts) == 3                                   # null timestamps group together
    nulls = by_ts[by_ts["submitted_at"].isna()]
    assert list(nulls["attempt_id"]) == [7]
    pairs = O.dedup_newest(df, ["user_key", "item"], ["is_ac"]).toPandas()
    assert list(pairs["attempt_id"]) == [2]                  # newest non-null time wins (nulls last)


def test_first_try_uses_explicit_order_v4(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(1, "I_1", 800, 1, 0, 0, 0, t2, 2), (1, "I_1", 800, 0, 1, 0, 0, t1, 1),   # first = fail
            (1, "I_2", 800, 1, 0, 0, 0, t1, 3)]                                         # single AC
    r = O.first_try_rates(_att(spark, rows)).first()
    assert r["ftr_b"] == 0.5 and r["ftr_a"] == 0.5 and abs(r["ftr_c"] - 0.5) < 1e-12


def test_peer_medians_empty_groups_are_zero(spark):
    stats = spark.createDataFrame(
        [(10, "dp", 0, 0, 0.0, 0), (11, "dp", 0, 0, 0.0, 0)],
        "user_key long, tag string, solved long, attempted long, avg_difficulty double, total_solved long")
    peers = spark.createDataFrame([(1, 10), (1, 11)], "target_key long, peer_key long")
    m = B.peer_medians(peers, stats).first()
    assert m["peer_median_acceptance"] == 0.0 and m["peer_median_difficulty"] == 0.0
    assert m["peer_median_specialization"] == 0.0 and m["peer_median_solved"] == 0.0


def test_strongest_weakest_ties_take_tag_order(spark):
    ut = spark.createDataFrame([(1, "greedy", 0.5, 1), (1, "dp", 0.5, 1), (1, "math", 0.2, 0)],
                               "user_key long, tag string, tag_strength double, ac_count long")
    assert S.strongest_tag(ut).first()["strongest_tag_computed"] == "dp"
    w = S.weakest_tag(ut).first()
    assert w["weakest_tag_computed"] == "dp"                  # math has no AC: not eligible


def test_run_log_analysis(spark):
    d = tempfile.mkdtemp()
    runs = {"runs": [
        {"timestamp": "t0", "user_handle": "a", "stages": [
            {"stage": s, "execution_time_seconds": 1.0 + i, "memory_usage_mb": 10.0, "timestamp": "x"}
            for i, s in enumerate(RL.EXPECTED_STAGES)]},
        {"timestamp": "t1", "user_handle": "b", "stages": [
            {"stage": "data_collection", "execution_time_seconds": 0.0, "memory_usage_mb": -1.0, "timestamp": "x"}]},
    ]}
    with open(os.path.join(d, "log.json"), "w") as f:
        json.dump(runs, f)
    st = IO.read_run_logs(spark, d)
    avg = {r.stage: r for r in RL.stage_averages(st).collect()}
    assert avg["data_collection"].runs == 2 and abs(avg["data_collection"].avg_seconds - 0.5) < 1e-12
    summ = {r.run_idx: r for r in RL.run_summary(st).collect()}
    assert summ[0].slowest_stage == "recommendation_generation" and summ[0].n_stages == 5
    issues = {(r.run_idx, r.issue) for r in RL.validate_runs(st).collect()}
    assert (1, "missing_stage") in issues and (1, "non_positive_time") in issues and (1, "negative_memory") in issues
    assert not any(i[0] == 0 for i in issues)
    empty = tempfile.mkdtemp()
    with open(os.path.join(empty, "bad.json"), "w") as f:
        f.write("{not json")
    assert IO.read_run_logs(spark, empty).count() == 0


def test_schema_preserving_empty_output(spark):
    d = tempfile.mkdtemp() + "/out"
    IO.write_schema_preserving(spark.createDataFrame([], "handle string, n long"), d)
    back = spark.read.option("header", True).csv(d)
    assert back.columns == ["handle", "n"] and back.count() == 0


def test_tag_normalisation(spark):
    df = spark.createDataFrame([(["Graph Matchings", "DP", "unknown", "dfs and similar", "implementation"],)],
                               "raw array<string>")
    assert df.select(C.normalise_tags(F.col("raw")).alias("t")).first()["t"] == ["graphs", "dp", "impl"]


def test_dedup_keeps_nulls_ids_and_types_for_every_payload(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, None, 1, None), (2, t, -3, 1, 0), (3, t, 2 ** 62, None, 1), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "user_key long, submitted_at timestamp, attempt_id long, is_ac tinyint, is_wa tinyint")
    for payload in (["is_ac", "is_wa"], ["is_ac", "is_wa", "name"]):
        src = df.withColumn("name", F.lit("n"))
        out = O.dedup_newest(src.unionByName(src), ["user_key"], payload)
        assert out.schema["submitted_at"].dataType == df.schema["submitted_at"].dataType
        got = out.select(*df.columns).orderBy("user_key").collect()
        assert [tuple(r) for r in got] == rows


def test_order_key_orders_any_id_like_the_struct(spark):
    t = dt.datetime(2024, 1, 1)
    ids = [None, -2 ** 63, -3, 0, 10 ** 13, 2 ** 63 - 1]
    df = spark.createDataFrame([(ti, i) for ti in (dt.datetime(1900, 1, 1), t, dt.datetime(9990, 1, 1)) for i in ids],
                               "submitted_at timestamp_ntz, attempt_id long")
    rows = df.withColumn("n", O.order_key_num(F.lit(1))).withColumn("s", O.order_key()).orderBy("s").collect()
    keys = [r["n"] for r in rows]
    assert None not in keys and keys == sorted(set(keys))
