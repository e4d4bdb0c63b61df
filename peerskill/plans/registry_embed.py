"""Registered queries over ``embeddings`` and the strength pivot (M-21, M-22, M-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RANK_ORDER, TAGS
from ..operators import components as PC
from ..operators import embeddings as EM
from ..operators import evaluate as EV
from ..operators import skill as S
from . import sql_blocks as Q
from .catalog import register
from .jobs import materialize

_KNN_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label,
      ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT AS h FROM embeddings),
  f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY h, vec_id) - 1) % 5 AS INTEGER) AS fold FROM v),
  pairs AS (SELECT a.vec_id AS target_key, b.vec_id AS peer_key, b.label AS plab, list_distance(a.vec, b.vec) AS d
            FROM f a JOIN f b ON a.fold <> b.fold),
  topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY round(d, 9), peer_key) AS rn
                          FROM pairs) WHERE rn <= 50),
  votes AS (SELECT target_key, plab, count(*) AS n FROM topk GROUP BY 1, 2),
  pred AS (SELECT target_key, plab AS predicted FROM (
             SELECT *, row_number() OVER (PARTITION BY target_key ORDER BY n DESC, plab) AS r FROM votes) WHERE r = 1),
  res AS (SELECT p.target_key, p.predicted, f.label AS actual, f.fold FROM pred p JOIN f ON f.vec_id = p.target_key)"""


def _pred(inp):
    return inp._get("knn_cls", lambda: EM.knn_classifier(inp.spark.read.parquet(f"{inp.sf_dir}/embeddings.parquet")))


@register("knn_classifier", _KNN_SQL + " SELECT target_key, predicted, actual, fold FROM res")
def knn_classifier(inp):
    """M-21 / W-11: stratified 5-fold KNN (k=50) label prediction for every embedding."""
    return _pred(inp).select("target_key", "predicted", "actual", "fold")


@register("confusion_matrix", _KNN_SQL + """ SELECT actual, predicted, count(*) AS n,
      round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY actual), 6) AS row_share FROM res GROUP BY 1, 2""")
def confusion_matrix(inp):
    """M-22: row-normalised confusion matrix of the KNN classifier."""
    return EV.confusion_matrix(_pred(inp), "actual", "predicted")


@register("classifier_accuracy", _KNN_SQL + " SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy,"
                                            " count(*) AS n FROM res")
def classifier_accuracy(inp):
    """M-22: accuracy of the KNN classifier."""
    return EM.classifier_accuracy(_pred(inp))


@register("pca_projection")
def pca_projection(inp):
    """M-24: 2-component centred PCA projection of every embedding (sign is arbitrary: no SQL oracle)."""
    proj, _ = EM.pca(inp.spark.read.parquet(f"{inp.sf_dir}/embeddings.parquet"))
    return proj


@register("pca_loadings")
def pca_loadings(inp):
    """M-24: PC1 loadings ranked by absolute value, explained variance of PC1/PC2."""
    _, load = EM.pca(inp.spark.read.parquet(f"{inp.sf_dir}/embeddings.parquet"))
    return load.orderBy(F.col("abs_loading").desc())


# M-24 / M-21 on the skill vectors --------------------------------------------------------

_AXES = [f"strength_{t}" for t in TAGS]
_LIST = "[" + ", ".join(f"coalesce(max(tag_strength) FILTER (WHERE tag = '{t}'), 0.0)" for t in TAGS) + "]::DOUBLE[]"
_PIVOT = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag(), f"x AS (SELECT user_key, {_LIST} AS v FROM user_tag GROUP BY user_key)",
          "mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS m FROM x, range(1, 21) r(i) GROUP BY i))",
          "cv AS (SELECT i, j, covar_samp(v[i], v[j]) AS c FROM x, range(1, 21) a(i), range(1, 21) b(j) GROUP BY i, j)"]


def _leading(name: str, matrix: str) -> list[str]:
    """The leading eigenvector of ``matrix`` (a table with a list of rows, m): the matrix is squared until only it is left."""
    return [
        f"{name}_p AS (SELECT 0 AS k, m FROM {matrix} UNION ALL SELECT k + 1, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q)"
        f" / list_sum(list_transform(m, lambda z: list_dot_product(z, z))))) FROM {name}_p WHERE k < 16)",
        f"{name}_r AS (SELECT r, list_dot_product(r, r) AS n FROM (SELECT unnest(m) AS r FROM {name}_p WHERE k = 16) ORDER BY n DESC LIMIT 1)",
        f"{name}_u AS (SELECT list_transform(r, lambda e: e / sqrt(n)) AS u FROM {name}_r)",
        f"{name} AS (SELECT list_transform(u, lambda e: e * sign(u[list_position(list_transform(u, lambda y: round(abs(y), 9)), list_max(list_transform(u, lambda y: round(abs(y), 9))))])) AS u FROM {name}_u)",
    ]


_COMPONENTS = "WITH RECURSIVE " + ",".join(b.strip().rstrip(",") for b in [
    *_PIVOT, "c0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cv GROUP BY i))", *_leading("e1", "c0"),
    "l1 AS (SELECT list_dot_product(u, list_transform(m, lambda r: list_dot_product(r, u))) AS l, u, m FROM e1, c0)",
    "c1 AS (SELECT list_transform(range(1, 21), lambda i: list_transform(range(1, 21), lambda j: m[i][j] - l * u[i] * u[j])) AS m FROM l1)", *_leading("e2", "c1"),
    "l2 AS (SELECT list_dot_product(e2.u, list_transform(c0.m, lambda r: list_dot_product(r, e2.u))) AS l FROM e2, c0)"])


def _strengths(inp):
    return inp._get("strengths", lambda: materialize(inp.spark, S.strength_pivot(inp.user_tag_table(), fill=0.0), "strengths"))


@register("strength_covariance", Q.with_(*_PIVOT) + " SELECT CAST(i - 1 AS INTEGER) AS a, CAST(j - 1 AS INTEGER) AS b, round(c, 6) AS cov FROM cv")
def strength_covariance(inp):
    """M-24: sample covariance of the 20 tag strengths over all users."""
    _, cov = PC.covariance(_strengths(inp), _AXES)
    return inp.spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))], "a int, b int, cov double")


@register("strength_pca", _COMPONENTS + """ SELECT user_key, round(list_dot_product(list_transform(range(1, 21), lambda i: v[i] - m[i]), e1.u), 6) AS pc1,
      round(list_dot_product(list_transform(range(1, 21), lambda i: v[i] - m[i]), e2.u), 6) AS pc2 FROM x, mu, e1, e2""")
def strength_pca(inp):
    """M-24: every user's two principal components of the strength pivot."""
    own = _strengths(inp)
    return PC.project(own, PC.fit(own, _AXES), "user_key")


@register("strength_pca_loadings", _COMPONENTS + " SELECT ['" + "', '".join(_AXES) + """'][i] AS feature, round(e1.u[i], 6) AS pc1_loading,
      round(e2.u[i], 6) AS pc2_loading, round(l1.l, 6) AS ev1, round(l2.l, 6) AS ev2 FROM range(1, 21) r(i), e1, e2, l1, l2""")
def strength_pca_loadings(inp):
    """M-24: loadings of the tag strengths on both components, and their explained variance."""
    own = _strengths(inp)
    return PC.loadings(own, PC.fit(own, _AXES))


_RANK = "CASE " + " ".join(f"WHEN cf_rating < {b} THEN {i}" for i, b in enumerate([1200, 1400, 1600, 1900, 2100, 2300, 2400])) + " ELSE 7 END"


@register("rank_classifier", Q.with_(*_PIVOT[:5]) + "," + _KNN_SQL.removeprefix("WITH ").replace(
    "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label,", f"SELECT x.user_key AS vec_id, v AS vec, CAST({_RANK} AS INTEGER) AS label,").replace(
    "md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT AS h FROM embeddings", "md5(CAST(x.user_key AS VARCHAR)), 1, 8))::BIGINT AS h FROM x JOIN profiles p ON p.user_key = x.user_key WHERE p.cf_rating > 0")
    + " SELECT target_key, predicted, actual, fold FROM res")
def rank_classifier(inp):
    """M-21: rank label of every rated user predicted from the strengths of its 50 nearest users of other folds."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RANK_ORDER]), F.col("cf_rank")) - 1
    own = _strengths(inp).join(inp.profiles_table().where("cf_rating > 0").select("user_key", rank.cast("int").alias("label")), "user_key")
    return EM.knn_classifier(own.select(F.col("user_key").alias("vec_id"), F.array(*_AXES).alias("embedding"), "label")).select("target_key", "predicted", "actual", "fold")
