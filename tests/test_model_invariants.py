"""Invariants for the model jobs, which have no SQL oracle."""

import __spark_entry__ as E

from .conftest import SF_SMALL

Q = E.queries()


def test_success_model_metrics_ranges(spark):
    r = Q["success_model_eval"](spark, SF_SMALL).first()
    assert r["n"] > 0 and r["mae"] >= 0 and r["rmse"] >= 0 and r["r2"] <= 1
    assert 0.0 <= r["auc"] <= 1.0 and 0.0 <= r["f1"] <= 1.0
    assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == r["n"]


def test_model_comparison_marks_one_best(spark):
    df = Q["attempts_model_comparison"](spark, SF_SMALL).toPandas()
    assert sorted(df["model"]) == ["boosted_trees", "linear", "logistic_ordinal"]
    assert df["best"].sum() >= 1 and (df["mae"] >= 0).all()


def test_ml_recommendations_ranges(spark):
    df = Q["recommendations_ml"](spark, SF_SMALL).toPandas()
    assert ((df["solve_score"] >= -0.2) & (df["solve_score"] <= 0.8)).all()          # sweet spot
    est = df["estimated_attempts"].dropna()
    assert ((est >= 1.0) & (est <= 10.0)).all()
    assert (df.loc[df["rec_rank"] > 50, "estimated_attempts"].isna()).all()        # top 50 only
    assert set(df["difficulty_label"].dropna()) <= {"easy", "moderate", "hard"}
    assert df.groupby("target_key")["rec_rank"].apply(lambda s: sorted(s) == list(range(1, len(s) + 1))).all()


def test_growth_predictions_non_negative(spark):
    df = Q["growth_predictions"](spark, SF_SMALL).toPandas()
    assert (df["predicted_potential"] >= 0).all()
    assert df["growth_tags"].map(lambda s: len([t for t in s.split(",") if t]) <= 5).all()


def test_model_roundtrip_and_pca(spark):
    rt = Q["model_roundtrip"](spark, SF_SMALL)
    rows = rt.collect()
    assert rows and rows[0]["n_features"] == 29 and all(r["same_prediction"] for r in rows)
    load = Q["pca_loadings"](spark, SF_SMALL).toPandas()
    assert len(load) == 64 and abs((load["pc1_loading"] ** 2).sum() - 1.0) < 1e-6


def test_model_counterfactual_covers_every_tag(spark):
    t = Q["tag_impact_ml"](spark, SF_SMALL).toPandas()
    assert len(t) > 0 and (t.groupby("target_key")["tag"].nunique() == 20).all()
    assert (t["delta_problems"] >= 0).all()
    assert (t.groupby("target_key")["impact_rank"].max() == 20).all()
