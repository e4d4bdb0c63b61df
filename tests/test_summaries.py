"""Exact quantiles from counting passes, components against numpy, and counts observed in passing."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from peerskill.operators import clean as C
from peerskill.operators import components as PC
from peerskill.operators import quantile as Q


@pytest.mark.parametrize("case", ["spread", "ties", "tiny", "one", "huge span"])
def test_quantiles_equal_numpy(spark, monkeypatch, case):
    monkeypatch.setattr(Q, "LAST", 20)
    monkeypatch.setattr(Q, "RANGES", 16)
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=3000), "ties": rng.integers(0, 4, 2001) / 3, "tiny": 1 + rng.random(500) * 1e-13, "one": np.array([2.5]),
         "huge span": np.r_[rng.normal(size=999), 1e300, -1e300, 1e-300]}[case]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(4)
    for q in (0.0, 0.31, 0.5, 1.0):
        assert Q.exact_quantile(df, "x", q) == pytest.approx(np.quantile(x, q), rel=1e-12, abs=0)
    assert Q.exact_quantile(df.limit(0), "x", 0.5) is None


def test_no_task_gets_all_rows(spark):
    df = spark.range(100_000).selectExpr("rand(5) as x")
    place = df.groupBy(F.floor(F.col("x") * 10)).agg(F.count("*"))
    assert "SinglePartition" not in place._jdf.queryExecution().toString()


def test_components_equal_an_eigendecomposition(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) + 1000.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "user_key long, a double, b double, c double, d double, e double")
    names = list("abcde")
    model = PC.fit(df, names)
    assert np.allclose(model.covariance, np.cov(x.T), rtol=1e-9) and np.allclose(model.mean, x.mean(axis=0))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for i in range(2):
        v = vectors[:, -1 - i]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(model.vectors[i], v, atol=1e-8) and np.isclose(model.variance[i], values[-1 - i])
    got = PC.project(df, model, "user_key").orderBy("user_key").toPandas()
    assert np.allclose(got[["pc1", "pc2"]], (x - x.mean(axis=0)) @ model.vectors.T, atol=1e-6)
    assert PC.loadings(df, model).count() == 5
    assert (PC.covariance(df.limit(1), names)[1] == 0).all() and (PC.covariance(df.limit(0), names)[1] == 0).all()


def test_dropped_handles_are_counted_in_the_same_pass(spark):
    rows = [("a",), (" =@b",), ("=#NAME?",), ("  ",), (None,), ("#NAME?",), ("+-",)]
    df, seen = spark.createDataFrame(rows, "handle string"), Observation()
    kept = C.clean_handles(df, observed=seen).collect()
    assert sorted(r.handle for r in kept) == ["a", "b"] and seen.get == {"rows": 7, "dropped": 5}
