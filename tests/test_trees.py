"""Stored ensembles: predictions and importances from the node table, early stopping, and the metrics of the trained models."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from peerskill.operators import evaluate as EV
from peerskill.operators import models as M
from peerskill.operators import trees as T


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4)).round(2)
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + 0.5 * x[:, 1] * (x[:, 2] > 0.3) + rng.normal(0, 0.1, 800)
    rows = [(i, *map(float, r), float(t), bool(i % 10 == 0)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "user_key long, a double, b double, c double, d double, y double, is_valid boolean").cache()


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_nodes_give_predictions_and_importances(spark, frame, kind):
    last = GBTRegressor(labelCol="y", maxIter=12, maxDepth=4, seed=1, subsamplingRate=0.8) if kind == "boosted" else RandomForestRegressor(labelCol="y", numTrees=9, maxDepth=3, seed=2)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features"), last]).fit(frame)
    stored = T.saved(model, "t")
    got = T.predict(model.transform(frame).withColumnRenamed("prediction", "fitted"), stored).toPandas()
    assert np.allclose(got.prediction, got.fitted, atol=1e-12) and got.prediction.nunique() > 20
    imp = T.importances(stored).orderBy("position").toPandas()
    assert np.allclose(imp.gain, model.stages[-1].featureImportances.toArray())
    assert imp.splits.sum() == (model.stages[-1].totalNumNodes - model.stages[-1].getNumTrees) // 2
    nodes = stored.nodes.toPandas()
    counts = nodes.feature.value_counts()
    assert [counts.get(f, 0) for f in imp.feature] == imp.splits.tolist()
    assert T.top_features(stored, 2).count() == 2


def test_early_stopping_waits(frame):
    params = dict(step_size=0.1, max_depth=3, min_instances=5, subsample=1.0, max_iter=60)
    model = M.fit_boosted(frame, ["a", "b", "c", "d"], "y", params, patience=5).stages[-1]
    assert 10 < model.getNumTrees <= 60  # a learnable target is not given up after the first round
    noise = frame.withColumn("y", F.rand(3))
    assert M.fit_boosted(noise, ["a", "b"], "y", params, patience=5).stages[-1].getNumTrees < 60
    every = frame.withColumn("is_valid", F.lit(False))
    assert M.fit_boosted(every, ["a", "b"], "y", params, iters=7, patience=5).stages[-1].getNumTrees == 7


def test_best_round_needs_no_further_fit(spark, frame, monkeypatch):
    fitted = []
    original = M._gbt
    monkeypatch.setattr(M, "_gbt", lambda label, params, iters: fitted.append(iters) or original(label, params, iters))
    params = dict(step_size=0.1, max_depth=3, min_instances=5, subsample=0.8, max_iter=60)
    noise = frame.withColumn("y", F.round(F.xxhash64("user_key") % 1000 / 1000.0, 3)).cache()
    cut = M.fit_boosted(noise, ["a", "b", "c", "d"], "y", params, patience=5)
    best = cut.stages[-1].getNumTrees
    assert best < fitted[-1] <= 20  # one more fit, of the best number, before
    fit = cut.stages[0].transform(noise).filter("not is_valid").coalesce(1)
    again = original("y", params, best).fit(fit)
    assert cut.stages[-1].toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1]
    assert cut.stages[-1].getMaxIter() == best and np.allclose(cut.stages[-1].featureImportances.toArray(), again.featureImportances.toArray())
    assert T.saved(cut, "cut").nodes.select("tree").distinct().count() == best


def test_rounds_to_fit_next():
    falls = [1.0 / (i + 1) for i in range(300)]
    assert M.stopping_round(falls[:51], 50) == (51, 204)  # still falling
    flat = falls[:13] + [1.0] * 38
    assert M.stopping_round(flat, 50) == (13, 63)  # 204 before; 63 rounds end the wait
    assert M.stopping_round(flat + [1.0] * 12, 50) == (13, 0)
    assert M.stopping_round(flat + [1.0] * 12 + [0.0], 50) == (13, 0)  # it has stopped by then
    assert M.stopping_round(flat + [0.01], 50) == (52, 208)


def test_a_falling_error_is_fitted_twice_at_most(frame, monkeypatch):
    fitted = []
    original = M._gbt
    monkeypatch.setattr(M, "_gbt", lambda label, params, iters: fitted.append(iters) or original(label, params, iters))
    monkeypatch.setattr(M, "ROUNDS_CAP", None)
    monkeypatch.setattr(M, "ROWS_PER_TASK", 500)
    params = dict(step_size=0.01, max_depth=3, min_instances=5, subsample=1.0, max_iter=40)  # slow steps: the error falls to the end
    model = M.fit_boosted(frame, ["a", "b", "c", "d"], "y", params, patience=5).stages[-1]
    assert fitted == [6, 40] and model.getNumTrees == 40  # 6, 24 and 40 before
    fit = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(frame).filter("not is_valid").coalesce(2)
    assert model.toDebugString.split("\n", 1)[1] == original("y", params, 40).fit(fit).toDebugString.split("\n", 1)[1]
    assert M.next_rounds(51, 63, 500, 9) == 63 and M.next_rounds(51, 101, 90, 9) == 90
    assert M.next_rounds(51, 204, 500, 1) == 204  # few rows: their error turns sooner


def test_metrics_of_a_trained_model_equal_numpy(frame):
    fit, test = frame.filter("user_key % 5 > 0"), frame.filter("user_key % 5 = 0")
    params = dict(step_size=0.1, max_depth=3, min_instances=5, subsample=1.0, max_iter=20)
    scored = M.fit_boosted(fit, ["a", "b", "c", "d"], "y", params).transform(test).withColumnRenamed("prediction", "pred")
    p = scored.toPandas()
    e = p.pred - p.y
    r = EV.regression_metrics(scored).first()
    assert np.allclose([r.n, r.mae, r.mse, r.r2], [len(p), e.abs().mean(), (e**2).mean(), 1 - (e**2).sum() / ((p.y - p.y.mean()) ** 2).sum()])
    line, want = EV.fit_line(scored).first(), np.polyfit(p.y, p.pred, 1)
    assert np.allclose([line.slope, line.intercept], want)
    bins = EV.residual_histogram(scored, bins=7).toPandas().set_index("bin").n
    assert bins.reindex(range(7), fill_value=0).tolist() == np.histogram(e, 7)[0].tolist()
    scored = scored.withColumn("yb", (F.col("y") > 1).cast("int"))
    pos, neg = p.pred[p.y > 1].to_numpy(), p.pred[p.y <= 1].to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(EV.exact_auc(scored, "pred", "yb").first().auc, auc)
