"""T-1..T-3 against the batch result: files out of time order, duplicates across batches, a restart."""

import datetime as dt

from pyspark.sql import functions as F

from peerskill.operators import ordered as O
from peerskill.streaming import incremental as ST

SCHEMA = ("user_key long, item string, is_ac tinyint, is_wa tinyint, is_tle tinyint, is_mle tinyint, "
          "submitted_at timestamp, attempt_id long")
KEYS = ["user_key", "item", "submitted_at"]


def _rows(years):
    return [(u, f"I_{u % 3}", (u + y) % 2, 1 - (u + y) % 2, 0, 0, dt.datetime(y, 1, 1 + u), 100 * y + u)
            for y in years for u in range(10)]


#: Newest file first; the third repeats rows of the first, the last holds a null time.
FILES = [_rows([2024, 2025]), _rows([2020]), _rows([2025, 2019]), _rows([2022]),
         [(1, "I_1", 1, 0, 0, 0, None, 7), (1, "I_1", 1, 0, 0, 0, None, 7)]]


def _put(spark, folder, i):
    spark.createDataFrame(FILES[i], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def _sorted(df):
    return sorted(df.collect(), key=str)


def test_streams_equal_the_batch_result_after_a_restart(spark, tmp_path):
    src = f"{tmp_path}/in"
    items = spark.createDataFrame([(f"I_{i}", ["dp", "math"][:i]) for i in range(3)], "item string, tags array<string>")
    for part in ([0, 1, 2], [3, 4]):                 # the second pass goes on from the same folders
        for i in part:
            _put(spark, src, i)
        t1 = ST.ingest_dedup(spark, _stream(spark, src), KEYS, f"{tmp_path}/t1")
        t2 = ST.stream_upsert_newest(spark, _stream(spark, src), ["user_key", "item"], ["is_ac", "is_wa"], f"{tmp_path}/t2")
        t3 = ST.running_user_tag_counts(spark, _stream(spark, src), items, f"{tmp_path}/t3")
        batch = spark.read.schema(SCHEMA).parquet(src)
        assert _sorted(t1) == _sorted(batch.distinct())
        assert _sorted(t2) == _sorted(O.dedup_newest(batch, ["user_key", "item"], ["is_ac", "is_wa"]))
        want = (batch.join(items, "item").select("user_key", "is_ac", "is_wa", F.explode("tags").alias("tag"))
                .groupBy("user_key", "tag").agg(F.count(F.lit(1)).alias("total_attempts"), F.sum("is_ac").alias("ac_count"),
                                                F.sum("is_wa").alias("wa_count")))
        assert _sorted(t3) == _sorted(want.select(*t3.columns))


def test_empty_stream_gives_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    assert ST.ingest_dedup(spark, _stream(spark, f"{tmp_path}/in"), KEYS, f"{tmp_path}/t1").count() == 0


# Compaction -------------------------------------------------------------------------

ITEMS = [(f"I_{i}", ["dp", "math"][:i]) for i in range(3)]


def _counts(batch, items):
    return (batch.join(items, "item").select("user_key", "is_ac", "is_wa", F.explode("tags").alias("tag"))
            .groupBy("user_key", "tag").agg(F.count(F.lit(1)).alias("total_attempts"), F.sum("is_ac").alias("ac_count"), F.sum("is_wa").alias("wa_count")))


def _folders(path):
    return sorted(p.name for p in path.iterdir() if "=" in p.name)


def test_reads_stay_bounded_over_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT_EVERY", 4)
    monkeypatch.setattr(ST, "BUCKETS", 3)
    items = spark.createDataFrame(ITEMS, "item string, tags array<string>")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([r for y in range(1970, 2020) for r in _rows([y])], SCHEMA).repartition(50).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = ST.running_user_tag_counts(spark, stream, items, f"{tmp_path}/t3")
    assert _sorted(got) == _sorted(_counts(spark.read.parquet(f"{tmp_path}/in"), items).select(*got.columns))
    files = max(r["batchId"] for r in spark.read.json(f"{tmp_path}/t3/checkpoint/commits").selectExpr("cast(regexp_extract(input_file_name(), '([0-9]+)$', 1) as int) as batchId").collect())
    assert files >= 45  # micro-batches
    assert len(_folders(tmp_path / "t3" / "data")) <= 4 and len(_folders(tmp_path / "t3" / "manifest")) <= 2
    assert len({f.split("/")[-1] for f in got.inputFiles()}) <= 3 * (4 + 4) + 2  # a snapshot and at most four epochs of three buckets


def test_only_touched_buckets_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ST, "COMPACT_EVERY", 1)
    monkeypatch.setattr(ST, "BUCKETS", 16)
    for i in (0, 1):
        rows = [(u, "I_1", 1, 0, 0, 0, dt.datetime(2020, 1, 1 + i), u) for u in (range(40) if i == 0 else [7])]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = ST.stream_upsert_newest(spark, _stream(spark, f"{tmp_path}/in"), ["user_key", "item"], ["is_ac"], f"{tmp_path}/t2")
    assert got.count() == 40 and got.where("user_key = 7").first().submitted_at == dt.datetime(2020, 1, 2)
    snapshot = tmp_path / "t2" / "snapshot"
    assert len(_folders(snapshot / "v=1")) == 1 and len(_folders(snapshot / "v=0")) > 8


def _stops(monkeypatch, name):
    """The first call of ``name`` fails, as if the driver were lost there."""
    real, calls = getattr(ST, name), []

    def stop(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(ST, name, stop)
    return calls


def _stopped_and_run_again(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(ST, "COMPACT_EVERY", 2)
    monkeypatch.setattr(ST, "BUCKETS", 3)
    items = spark.createDataFrame(ITEMS, "item string, tags array<string>")
    src = f"{tmp_path}/in"
    for i in range(5):
        _put(spark, src, i)
    calls = _stops(monkeypatch, name)
    jobs = {
        "t3": lambda: ST.running_user_tag_counts(spark, _stream(spark, src), items, f"{tmp_path}/t3"),
        "t1": lambda: ST.ingest_dedup(spark, _stream(spark, src), KEYS, f"{tmp_path}/t1"),
    }
    batch = spark.read.schema(SCHEMA).parquet(src)
    for job, run in jobs.items():
        calls.clear()
        try:
            run()
            raise AssertionError("not stopped")
        except Exception as e:  # noqa: BLE001
            assert "lost" in str(e)
        got = run()
        want = _counts(batch, items).select(*got.columns) if job == "t3" else batch.distinct()
        assert _sorted(got) == _sorted(want) and len(calls) > 1


def test_a_stop_before_the_commit_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    _stopped_and_run_again(spark, tmp_path, monkeypatch, "_commit")


def test_a_stop_after_the_commit_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    _stopped_and_run_again(spark, tmp_path, monkeypatch, "_drop")
