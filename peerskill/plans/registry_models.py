"""Registered model jobs (M-4..M-8, M-13..M-16, M-18, M-19, M-23, S-10).

Solvers have no SQL equivalent.  The fitted trees are read back as node tables
(``trees``): ``ensemble_nodes`` recomputes every model's predictions and
importances from the stored nodes, row by row against the rows that SQL
expects; the metrics are recomputed in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PROFILE_FEATURES, TAGS
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import models as M
from ..operators import recommend as R
from ..operators import scoring as SC
from ..operators import skill as S
from ..operators import trees as T
from ..session import scratch_path
from . import sql_blocks as Q
from .catalog import register
from .jobs import materialize
from .refresh import source_fingerprint
from .registry_eval import _FRAME


#: Models of this process, by application, name and the fingerprints of the files that they are trained on.
_TRAINED: dict[tuple, object] = {}


def _trained(inp, name, fit):
    """The fitted model ``name``: trained once for all queries of an application over the same files."""
    sources = tuple(source_fingerprint(inp.spark, f"{inp.sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    key = (inp.spark.conf.get("spark.app.id", ""), name, inp.sf_dir, inp.settings, M.ROUNDS_CAP, sources)
    if key not in _TRAINED:
        _TRAINED[key] = fit()
    return _TRAINED[key]


def _success_model(inp):
    return _trained(inp, "success", lambda: M.fit_success(inp.success_frame()))


def _attempts_model(inp):
    return _trained(inp, "attempts", lambda: M.fit_attempts(inp.attempts_frame()))


def _growth_model(inp):
    return _trained(inp, "growth", lambda: M.fit_growth(inp.growth_frame()))


@register("success_model_eval")
def success_model_eval(inp):
    """M-4 / M-9 / M-10: boosted-tree success model, test-split metrics incl. exact AUC."""
    test = _success_model(inp).transform(inp.success_frame().filter(F.col("split") == "test"))
    t = test.select(F.col("solve_score").alias("y"), F.col("prediction").alias("pred"),
                    (F.col("solve_score") >= 0.5).cast("int").alias("yb"))
    b = EV.binary_metrics(t)
    return EV.regression_metrics(t).select(
        "*", *[b.select(c).scalar().alias(c) for c in ["tp", "fp", "fn", "tn", "f1"]],
        EV.exact_auc(t, "pred", "yb").select("auc").scalar().alias("auc"))


@register("success_feature_importance")
def success_feature_importance(inp):
    """M-14 / L-6: top-15 features of the success model by split count."""
    return M.feature_importance(_success_model(inp), 15)


def _forest_frame(inp):
    def build():
        piv = S.strength_pivot(inp.user_tag_table(), fill=0.0)
        frame = piv.join(inp.profiles_table().select("user_key", "first_try_rate"), "user_key")
        return materialize(inp.spark, EV.shuffled_folds(frame, "user_key"), "forest_frame")
    return inp._get("forest_frame", build)


_FOREST_FEATURES = [f"strength_{t}" for t in TAGS]


def _ensembles(inp, names=("success", "attempts", "growth", "forest")):
    """(name, fitted pipeline, rows that it has not seen) of the tree models ``names``."""
    test = lambda df: df.filter(F.col("split") == "test")
    no_item = lambda df: df.withColumn("item", F.lit(None).cast("string"))
    forest = lambda: M.fit_forest(_forest_frame(inp).filter("fold <> 0"), _FOREST_FEATURES, "first_try_rate")
    of = {
        "success": lambda: (_success_model(inp), test(inp.success_frame())), "attempts": lambda: (_attempts_model(inp), test(inp.attempts_frame())),
        "growth": lambda: (_growth_model(inp), no_item(test(inp.growth_frame()))),
        "forest": lambda: (inp._get("m_forest", forest), no_item(_forest_frame(inp).filter("fold = 0"))),
    }
    return [(n, *of[n]()) for n in names]


_HASHED = "('0x' || substr(md5(CAST(user_key AS VARCHAR)), 1, 8))::BIGINT % 5 = 0"
_SKILLED = f"FROM profiles WHERE user_key IN (SELECT user_key FROM user_tag) AND {_HASHED}"


def _feature_rows(name, features):
    return ", ".join(f"('{name}', '{f}', {i})" for i, f in enumerate(features))


_MODEL_FEATURES = (("success", SC.FEATURE_NAMES), ("attempts", SC.FEATURE_NAMES), ("growth", PROFILE_FEATURES + _FOREST_FEATURES), ("forest", _FOREST_FEATURES))


@register("ensemble_nodes", Q.with_(*_FRAME) + f"""
      SELECT 'success' AS model, 'prediction' AS kind, user_key, item AS name, -1 AS position, true AS same FROM sframe WHERE split = 'test'
      UNION ALL SELECT 'attempts', 'prediction', user_key, item, -1, true FROM sframe WHERE split = 'test' AND ever_ac = 1
      UNION ALL SELECT 'growth', 'prediction', user_key, NULL, -1, true {_SKILLED}
      UNION ALL SELECT 'forest', 'prediction', user_key, NULL, -1, true {_SKILLED}
      UNION ALL SELECT model, 'importance', -1, feature, CAST(position AS INTEGER), true
      FROM (VALUES {", ".join(_feature_rows(*x) for x in _MODEL_FEATURES)}) v(model, feature, position)""")
def ensemble_nodes(inp):
    """M-4..M-6 / M-14 / M-23: the fitted trees read back as node tables.  Every test row is scored by walking the stored nodes (``same``:
    as the fitted model does), and every feature's gain share and the number of splits are summed from them (``same``: as the model's)."""
    out = None
    for name, model, rows in _ensembles(inp):
        stored, fitted = T.saved(model, name), model.stages[-1]
        scored = T.predict(model.transform(rows).withColumnRenamed("prediction", "fitted"), stored)
        close = F.abs(F.col("prediction") - F.col("fitted")) <= 1e-9 * (1 + F.abs("fitted"))
        walked = scored.select(F.lit(name).alias("model"), F.lit("prediction").alias("kind"), "user_key", F.col("item").alias("name"),
                               F.lit(-1).alias("position"), close.alias("same"))
        gains = F.array(*[F.lit(float(x)) for x in fitted.featureImportances.toArray()])  # a number per feature
        own, inner = T.importances(stored), (fitted.totalNumNodes - fitted.getNumTrees) // 2
        summed = own.select(F.lit(name).alias("model"), F.lit("importance").alias("kind"), F.lit(-1).cast("long").alias("user_key"), F.col("feature").alias("name"),
                            "position", ((F.abs(F.get(gains, F.col("position")) - F.col("gain")) < 1e-9) & (own.agg(F.sum("splits")).scalar() == inner)).alias("same"))
        part = walked.unionByName(summed)
        out = part if out is None else out.unionByName(part)
    return out


@register("model_diagnostics")
def model_diagnostics(inp):
    """M-11..M-14 of the trained models: the top-15 features by split count (attempts, growth, forest), errors by rating band (attempts,
    growth) and the mean prediction by actual attempts."""
    parts = []

    def add(name, kind, df, label, n, value):
        parts.append(df.select(F.lit(name).alias("model"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"),
                               F.col(n).alias("n"), F.col(value).alias("value")))

    for name, model, rows in _ensembles(inp, ("attempts", "growth", "forest")):
        add(name, "splits_and_gain", M.feature_importance(model, 15), "feature", "splits", "gain")
        if name != "forest":
            lo, hi = M.ATTEMPTS_CLIP_RANGE if name == "attempts" else (0.0, float("inf"))
            scored = model.transform(rows).withColumn("p", F.least(F.greatest("prediction", F.lit(lo)), F.lit(hi)))
            add(name, "mae_by_band", EV.mae_by_band(scored, "cf_rating", y=name, p="p"), "band", "n", "mae")
        if name == "attempts":
            add(name, "calibration", EV.calibration(scored, y=name, p="p"), "actual", "n", "mean_pred")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("forest_residuals")
def forest_residuals(inp):
    """M-25 / M-26 of the cross-validated forest: 60-bin residual histogram with the slope and intercept of predicted on actual."""
    s = materialize(inp.spark, M.rf_cross_validated(_forest_frame(inp), _FOREST_FEATURES, "first_try_rate"), "forest_scored")
    line = EV.fit_line(s)
    return EV.residual_histogram(s).select("*", line.select("slope").scalar().alias("slope"), line.select("intercept").scalar().alias("intercept"))


@register("attempts_model_comparison")
def attempts_model_comparison(inp):
    """M-5 / M-7 / M-8 / M-13: boosted trees vs linear vs ordinal logistic on the attempts target."""
    f = inp.attempts_frame()
    test = f.filter(F.col("split") == "test")
    clip = M.ATTEMPTS_CLIP_RANGE
    gbt = M.eval_table(_attempts_model(inp).transform(test), "attempts", "boosted_trees", clip)
    lin = M.eval_table(M.fit_linear(f, SC.FEATURE_NAMES, "attempts").transform(test), "attempts", "linear", clip)
    log = M.eval_table(M.ordinal_logistic(f, SC.FEATURE_NAMES, "attempts"), "attempts", "logistic_ordinal", clip)
    return M.compare_models([gbt, lin, log])


@register("growth_model_comparison")
def growth_model_comparison(inp):
    """M-6 / M-7 / M-8 / M-13 on the growth target (predictions clipped at 0)."""
    f = inp.growth_frame()
    feats = M.growth_features(f)
    test = f.filter(F.col("split") == "test")
    clip = (0.0, 1e9)
    gbt = M.eval_table(_growth_model(inp).transform(test), "growth", "boosted_trees", clip)
    lin = M.eval_table(M.fit_linear(f, feats, "growth").transform(test), "growth", "linear", clip)
    log = M.eval_table(M.ordinal_logistic(f, feats, "growth"), "growth", "logistic_ordinal", clip)
    return M.compare_models([gbt, lin, log])


@register("growth_predictions")
def growth_predictions(inp):
    """M-18 / L-7: predicted potential, peak and top-5 weak growth tags for every user."""
    return M.growth_predictions(_growth_model(inp), inp.growth_frame())


@register("recommendations_ml")
def recommendations_ml(inp):
    """M-15 / M-16 / M-19 with the trained success and attempts models as scorers."""
    recs = R.prioritise(inp.features(), inp.peer_strength(), inp.settings.recommend,
                        success_scorer=M.ml_success_scorer(_success_model(inp)),
                        attempts_scorer=M.ml_attempts_scorer(_attempts_model(inp)))
    return recs.select("target_key", "item", "item_rating", "collab_score", "solve_score", "difficulty_match",
                       "weakness_boost", "final_score", "rec_rank", "estimated_attempts", "difficulty_label")


@register("tag_impact_ml")
def tag_impact_ml(inp):
    """M-17 with the trained success model: every pool item rescored with each of its tags raised."""
    return R.counterfactual_impact(inp.features(), inp.context(), inp.settings.recommend,
                                   success_scorer=M.ml_success_scorer(_success_model(inp))).select(
        "target_key", "tag", "strength", "delta_problems", "estimated_rating_gain", "label", "impact_rank")


@register("rf_first_try_cv")
def rf_first_try_cv(inp):
    """M-23: 5-fold random forest, tag strengths -> first-try rate: R^2, MAE, residual mean / std."""
    s = materialize(inp.spark, M.rf_cross_validated(_forest_frame(inp), _FOREST_FEATURES, "first_try_rate"), "forest_scored")
    r = F.col("pred") - F.col("y")
    return EV.regression_metrics(s).select(
        "n", "mae", "r2", s.agg(F.avg(r)).scalar().alias("residual_mean"),
        s.agg(F.stddev_pop(r)).scalar().alias("residual_std"))


@register("model_roundtrip", Q.with_(*_FRAME) + f""" SELECT user_key, item, round(solve_score, 6) AS solve_score, true AS same_prediction,
      {len(SC.FEATURE_NAMES)} AS n_features FROM sframe WHERE split = 'test'""")
def model_roundtrip(inp):
    """S-10: save the success model with its metadata to the shared folder, load it back and compare
    its predictions of the test split with those of the model in memory."""
    path = scratch_path(inp.spark, "success_model")
    fitted = _success_model(inp)
    M.save_model(fitted, path, {"features": SC.FEATURE_NAMES, "wa_penalty": FE.WA_PENALTY,
                                "attempts_clip": M.ATTEMPTS_CLIP_RANGE[1]})
    model, meta = M.load_model(path)
    test = inp.success_frame().filter(F.col("split") == "test")
    scored = fitted.transform(test).withColumnRenamed("prediction", "fitted_pred").drop("features")
    return model.transform(scored).select(
        "user_key", "item", "solve_score", (F.abs(F.col("prediction") - F.col("fitted_pred")) < 1e-9).alias("same_prediction"),
        F.lit(len(meta["features"])).alias("n_features"))
