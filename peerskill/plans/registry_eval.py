"""Registered queries: model frames, metrics on fixed (closed-form) predictions, LOO KNN quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import K_NEIGHBORS
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import scoring as SC
from . import sql_blocks as Q
from .catalog import register, rounded_select

_FRAME = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.per_item("clean", "spi"), Q.success_frame()]
_PEERS = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), Q.TAG_DIM, Q.vectors(), Q.peers()]


def _pred(inp):
    """Success frame with the closed-form success and attempts predictions."""
    f = inp.success_frame()
    return f.withColumn("pred", SC.sql_solve_score(F.col("rating_diff"), F.col("mean_tag_strength"))).withColumn(
        "attempts_pred", SC.sql_attempts(F.col("rating_diff"), F.col("mean_tag_strength")))


_SF_COLS = ["user_key", "item", "item_rating", "ever_ac", "wa_count", "cf_rating", "rating_diff", "mean_tag_strength",
            "tag_strength_min", "tag_strength_max", "problem_tag_count", "num_solved", "solve_score", "split"]
_SF_DBL = ["cf_rating", "rating_diff", "mean_tag_strength", "tag_strength_min", "tag_strength_max",
           "problem_tag_count", "num_solved", "solve_score"]


@register("success_training_frame", Q.with_(*_FRAME) + f" SELECT {rounded_select(_SF_COLS, _SF_DBL)} FROM sframe")
def success_training_frame(inp):
    """M-1: (user, item) feature frame with the solve_score target and the hash split."""
    return inp.success_frame().select(*_SF_COLS)


_SM = ["n", "mae", "mse", "rmse", "r2", "tp", "fp", "fn", "tn", "f1", "auc"]


@register(
    "success_metrics",
    Q.with_(*_FRAME, """t AS (SELECT solve_score AS y, pred, CASE WHEN solve_score >= 0.5 THEN 1 ELSE 0 END AS yb
                         FROM spred WHERE split = 'test'),
      g AS (SELECT pred, sum(yb) AS pos, sum(1 - yb) AS neg FROM t GROUP BY pred),
      c AS (SELECT pred, pos, neg, coalesce(sum(neg) OVER (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS neg_below FROM g),
      auc AS (SELECT sum(pos * (neg_below + neg * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM c),
      m AS (SELECT count(*) AS n, avg(abs(pred - y)) AS mae, avg((pred - y) * (pred - y)) AS mse,
                   sqrt(avg((pred - y) * (pred - y))) AS rmse,
                   1.0 - sum((pred - y) * (pred - y)) / (count(*) * var_pop(y)) AS r2,
                   count(*) FILTER (WHERE y >= 0.5 AND pred >= 0.5) AS tp, count(*) FILTER (WHERE y < 0.5 AND pred >= 0.5) AS fp,
                   count(*) FILTER (WHERE y >= 0.5 AND pred < 0.5) AS fn, count(*) FILTER (WHERE y < 0.5 AND pred < 0.5) AS tn
            FROM t)""")
    + " SELECT n, round(mae, 6) AS mae, round(mse, 6) AS mse, round(rmse, 6) AS rmse, round(r2, 6) AS r2, tp, fp, fn, tn,"
      " round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1, round(auc, 6) AS auc FROM m, auc",
)
def success_metrics(inp):
    """M-9 / M-10: MAE, MSE, RMSE, R^2, confusion at 0.5, F1 and exact AUC on the test split."""
    t = _pred(inp).filter(F.col("split") == "test").select(
        F.col("solve_score").alias("y"), "pred", (F.col("solve_score") >= 0.5).cast("int").alias("yb"))
    reg = EV.regression_metrics(t)
    binm = EV.binary_metrics(t)
    auc = EV.exact_auc(t, "pred", "yb")
    return reg.select("n", "mae", "mse", "rmse", "r2", *[binm.select(c).scalar().alias(c) for c in
                                                        ["tp", "fp", "fn", "tn", "f1"]],
                      auc.select("auc").scalar().alias("auc"))


@register(
    "attempts_band_mae",
    Q.with_(*_FRAME) + """ SELECT band, count(*) AS n, round(avg(abs(least(greatest(attempts_pred, 1.0), 10.0) - attempts)), 6) AS mae
      FROM (SELECT *, CASE WHEN cf_rating >= 900 AND cf_rating < 1200 THEN '900-1200'
                           WHEN cf_rating >= 1200 AND cf_rating < 1600 THEN '1200-1600'
                           WHEN cf_rating >= 1600 AND cf_rating < 2000 THEN '1600-2000'
                           WHEN cf_rating >= 2000 AND cf_rating < 2600 THEN '2000-2600' END AS band
            FROM spred WHERE ever_ac = 1 AND split = 'test') WHERE band IS NOT NULL GROUP BY band""",
)
def attempts_band_mae(inp):
    """M-11: attempts MAE by user-rating band (clipped closed-form predictions, test split)."""
    a = FE.attempts_frame(_pred(inp)).filter(F.col("split") == "test").withColumn(
        "p", SC.clip_attempts(F.col("attempts_pred")))
    return EV.mae_by_band(a, "cf_rating", y="attempts", p="p")


@register(
    "attempts_calibration",
    Q.with_(*_FRAME) + """ SELECT CAST(attempts AS INTEGER) AS actual, count(*) AS n,
        round(avg(least(greatest(attempts_pred, 1.0), 10.0)), 6) AS mean_pred
      FROM spred WHERE ever_ac = 1 AND split = 'test' AND attempts BETWEEN 1 AND 5 GROUP BY 1 HAVING count(*) > 10""",
)
def attempts_calibration(inp):
    """M-12: mean predicted attempts per actual 1..5 (n > 10)."""
    a = FE.attempts_frame(_pred(inp)).filter(F.col("split") == "test").withColumn(
        "p", SC.clip_attempts(F.col("attempts_pred")))
    return EV.calibration(a, y="attempts", p="p")


@register(
    "residual_histogram",
    Q.with_(*_FRAME, """r AS (SELECT pred - solve_score AS r FROM spred WHERE split = 'test'),
      b AS (SELECT min(r) AS lo, max(r) AS hi, avg(r) AS mean_r FROM r)""")
    + """ SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((r - lo) / ((hi - lo) / 60)), 59) END AS INTEGER) AS bin,
        count(*) AS n, round(any_value(lo), 6) AS lo, round(any_value(hi), 6) AS hi, round(any_value(mean_r), 6) AS mean_residual
      FROM r, b GROUP BY 1""",
)
def residual_histogram(inp):
    """M-25: 60-bin residual histogram of the success predictions (test split)."""
    t = _pred(inp).filter(F.col("split") == "test").select(F.col("solve_score").alias("y"), "pred")
    return EV.residual_histogram(t)


@register(
    "fit_line",
    Q.with_(*_FRAME) + " SELECT round(regr_slope(pred, solve_score), 6) AS slope,"
                       " round(regr_intercept(pred, solve_score), 6) AS intercept FROM spred WHERE split = 'test'",
)
def fit_line(inp):
    """M-26: slope / intercept of predicted on actual solve_score."""
    t = _pred(inp).filter(F.col("split") == "test").select(F.col("solve_score").alias("y"), "pred")
    return EV.fit_line(t)


@register(
    "score_distribution",
    Q.with_(*_FRAME) + """ SELECT round(avg(CASE WHEN solve_score >= -1.0 AND solve_score < 0.0 THEN 1.0 ELSE 0.0 END), 6) AS share_neg,
        round(avg(CASE WHEN solve_score >= 0.0 AND solve_score < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_0_05,
        round(avg(CASE WHEN solve_score >= 0.5 AND solve_score < 0.9 THEN 1.0 ELSE 0.0 END), 6) AS share_05_09,
        round(avg(CASE WHEN solve_score >= 0.9 AND solve_score < 1.01 THEN 1.0 ELSE 0.0 END), 6) AS share_09_1
      FROM sframe""",
)
def score_distribution(inp):
    """A-26: solve_score distribution over the training frame."""
    return FE.score_distribution(inp.success_frame())


@register(
    "attempts_distribution",
    Q.with_(*_FRAME) + " SELECT " + ", ".join(
        f"round(avg(CASE WHEN attempts = {i} THEN 1.0 ELSE 0.0 END), 6) AS share_{i}" for i in range(1, 6))
    + ", round(avg(CASE WHEN attempts > 5 THEN 1.0 ELSE 0.0 END), 6) AS share_gt5 FROM spred WHERE ever_ac = 1",
)
def attempts_distribution(inp):
    """A-27: attempts target distribution (solved rows)."""
    return FE.attempts_distribution(inp.attempts_frame())


@register(
    "growth_stats",
    Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag())
    + """ SELECT round(avg(g), 6) AS mean_growth, round(median(g), 6) AS median_growth, round(max(g), 6) AS max_growth,
        count(*) FILTER (WHERE g > 200) AS n_over_200
      FROM (SELECT CAST(greatest(cf_max_rating - cf_rating, 0) AS DOUBLE) AS g FROM profiles
            WHERE user_key IN (SELECT user_key FROM user_tag))""",
)
def growth_stats(inp):
    """A-28 / F-15: growth-potential target statistics over the M-2 frame."""
    return FE.growth_stats(inp.growth_frame())


_LOO = ["target_key", "weakness_jaccard", "weakness_recall", "tag_mse", "tag_spearman"]
_LOO_SQL = """
s AS (SELECT u.user_key, d.tag, d.ord, coalesce(t.tag_strength, 0.0) AS s
      FROM (SELECT DISTINCT user_key FROM user_tag) u CROSS JOIN tag_dim d
      LEFT JOIN user_tag t ON t.user_key = u.user_key AND t.tag = d.tag),
cent AS (SELECT p.target_key, s.tag, avg(s.s) AS c FROM peers p JOIN s ON s.user_key = p.peer_key GROUP BY 1, 2),
tc AS (SELECT s.user_key AS target_key, s.tag, s.s, c.c FROM s JOIN cent c ON c.target_key = s.user_key AND c.tag = s.tag),
rk AS (SELECT *, rank() OVER (PARTITION BY target_key ORDER BY round(s, 9))
                 + (count(*) OVER (PARTITION BY target_key, round(s, 9)) - 1) / 2.0 AS rt,
              rank() OVER (PARTITION BY target_key ORDER BY round(c, 9))
                 + (count(*) OVER (PARTITION BY target_key, round(c, 9)) - 1) / 2.0 AS rc
       FROM tc),
per AS (
  SELECT target_key,
         count(*) FILTER (WHERE s < 0.7 AND c < 0.7) AS n_inter, count(*) FILTER (WHERE s < 0.7 OR c < 0.7) AS n_union,
         count(*) FILTER (WHERE s < 0.7) AS n_tweak, avg((s - c) * (s - c)) AS tag_mse,
         CASE WHEN stddev_pop(rt) > 0 AND stddev_pop(rc) > 0 THEN corr(rt, rc) END AS tag_spearman
  FROM rk GROUP BY target_key),
loo AS (
  SELECT target_key, CASE WHEN n_union > 0 THEN n_inter * 1.0 / n_union END AS weakness_jaccard,
         CASE WHEN n_tweak > 0 THEN n_inter * 1.0 / n_tweak END AS weakness_recall, tag_mse, tag_spearman
  FROM per)"""


@register("loo_user_metrics", Q.with_(*_PEERS, _LOO_SQL) + f" SELECT {rounded_select(_LOO, _LOO[1:])} FROM loo")
def loo_user_metrics(inp):
    """M-20 per user: weak-set Jaccard / recall, tag MSE and Spearman vs the peer centroid."""
    return inp.loo_user_metrics().select(*_LOO)


@register(
    "loo_knn_quality",
    Q.with_(*_PEERS, _LOO_SQL) + f""" SELECT round(avg(weakness_jaccard), 6) AS weakness_jaccard,
        round(avg(weakness_recall), 6) AS weakness_recall, round(avg(tag_mse), 6) AS tag_mse,
        round(avg(tag_spearman), 6) AS tag_spearman, count(*) AS n_evaluated, {K_NEIGHBORS} AS k, 0.7 AS weak_threshold
      FROM loo""",
)
def loo_knn_quality(inp):
    """M-20: leave-one-out KNN quality over all users."""
    return EV.loo_summary(inp.loo_user_metrics(), K_NEIGHBORS)
