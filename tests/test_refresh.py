"""The refresh job goes on after a stop at any step, and runs anew what depends on a changed source."""

import pytest
from pyspark.sql import functions as F

from peerskill.plans import refresh as RF
from peerskill.plans.jobs import Inputs
from peerskill.sources import io as IO
from peerskill.sources import testdata as td

from .conftest import SF_SMALL

STEPS = ["merge", "skill", "frames", "model_success", "model_attempts", "model_growth", "metrics"]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("refresh")
    inp = Inputs(spark, SF_SMALL)
    wide = IO.attempts_to_wide(td.att_order(spark, SF_SMALL).join(inp.items_order().select("item", "tags"), "item"))
    part = F.pmod(F.col("submitted_at"), F.lit(3))
    wide.where(part == 2).coalesce(1).write.parquet(f"{base}/existing")
    for i in range(2):
        wide.where(part == i).coalesce(1).write.option("header", True).csv(f"{base}/chunk_{i}")
    inp.ratings().select(F.col("user_key").cast("string").alias("handle"), "cf_rating", "cf_max_rating", "cf_rank").write.parquet(f"{base}/ratings")
    return base


def _run(spark, sources, base):
    return RF.refresh(spark, str(base), [f"{sources}/chunk_{i}" for i in range(3)], f"{sources}/existing", f"{sources}/ratings", iters=3)


def test_a_stop_after_any_step_goes_on(spark, sources, tmp_path, monkeypatch):
    whole = _run(spark, sources, tmp_path / "whole")
    assert whole.ran == STEPS and whole.notes["merge"]["dropped"] == 0 and whole.notes["model_success"]["trees"] >= 1
    metrics = sorted(map(str, whole.read(whole.notes["folders"]["metrics"]).select("model", "n").collect()))
    real, done = RF.Job.step, []

    def stopping(self, name, *args, **kw):
        before = len(self.ran)
        out = real(self, name, *args, **kw)
        if len(self.ran) > before:
            done.append(name)
            raise RuntimeError("lost")  # the driver is gone after each step that it has done
        return out

    monkeypatch.setattr(RF.Job, "step", stopping)
    for _ in STEPS:
        with pytest.raises(RuntimeError, match="lost"):
            _run(spark, sources, tmp_path / "stopped")
    monkeypatch.undo()
    last = _run(spark, sources, tmp_path / "stopped")
    assert done == STEPS and last.ran == []
    assert sorted(map(str, last.read(last.notes["folders"]["metrics"]).select("model", "n").collect())) == metrics
    tables = [job.read(job.notes["folders"]["skill"], "user_tag").drop("tag_strength") for job in (whole, last)]
    assert tables[0].exceptAll(tables[1]).count() == 0 and tables[0].count() == tables[1].count() > 0


def test_a_stop_within_a_step_leaves_nothing_behind(spark, sources, tmp_path, monkeypatch):
    real = RF.skill_tables

    def half(wide, ratings, put):
        calls = []

        def stop(name, df):
            calls.append(name)
            if len(calls) == 3:
                raise RuntimeError("lost")
            return put(name, df)

        real(wide, ratings, stop)

    monkeypatch.setattr(RF, "skill_tables", half)
    with pytest.raises(RuntimeError, match="lost"):
        _run(spark, sources, tmp_path)
    monkeypatch.undo()
    assert _run(spark, sources, tmp_path).ran == STEPS[1:]


def test_a_changed_source_is_seen(spark, sources, tmp_path):
    args = ([f"{tmp_path}/new", f"{sources}/chunk_0"], f"{sources}/existing", f"{sources}/ratings")
    first = RF.refresh(spark, f"{tmp_path}/job", *args, models=False)
    rows = first.read(first.notes["folders"]["merged"]).count()
    spark.read.option("header", True).csv(f"{sources}/chunk_1").write.option("header", True).csv(f"{tmp_path}/new")
    second = RF.refresh(spark, f"{tmp_path}/job", *args, models=False)
    assert first.ran == second.ran == STEPS[:2]
    assert second.read(second.notes["folders"]["merged"]).count() > rows
    assert RF.refresh(spark, f"{tmp_path}/job", *args, models=False).ran == []
