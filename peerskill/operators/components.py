"""Principal components of the strength pivot (M-24): covariance as one aggregate, a fixed sign, projection as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Components:
    """``vectors``: a row per component; ``variance``: their explained variance (n - 1 in the denominator)."""

    names: list[str]
    mean: np.ndarray
    covariance: np.ndarray
    vectors: np.ndarray
    variance: np.ndarray


def covariance(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(means, sample covariance) of ``columns``: one aggregate for the means, one for the d * (d + 1) / 2 sums of centred products.  Both
    are partial aggregates of one row a task, whatever the rows.  Fewer than two rows give zeros."""
    d = len(columns)
    mean = np.array([x or 0.0 for x in df.agg(*[F.avg(c) for c in columns]).first()], float)
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]).first()
    out = np.zeros((d, d))
    out[np.tril_indices(d)] = [v or 0.0 for v in row[1:]]
    return mean, (out + np.tril(out, -1).T) / max(1, row[0] - 1)


def fit(df: DataFrame, columns: list[str], k: int = 2) -> Components:
    """The ``k`` leading eigenvectors of the covariance; each has its entry of greatest size (the first of equal ones) above 0."""
    mean, cov = covariance(df, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    v = vectors[:, order].T
    sizes = np.round(np.abs(v), 9)
    v = v * np.where(v[np.arange(len(v)), sizes.argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Components(columns, mean, cov, v, values[order])


def project(df: DataFrame, model: Components, *keep: str) -> DataFrame:
    """``keep`` and pc1, pc2, ... of every row, as sums of column products."""
    def score(v: np.ndarray):
        return sum((F.col(c) - F.lit(float(m))) * F.lit(float(w)) for c, m, w in zip(model.names, model.mean, v))

    return df.select(*keep, *[score(v).alias(f"pc{i + 1}") for i, v in enumerate(model.vectors)])


def loadings(df: DataFrame, model: Components) -> DataFrame:
    """feature, loading on each component, and the explained variance of each; a row per feature."""
    rows = [(c, *map(float, model.vectors[:, i]), *map(float, model.variance)) for i, c in enumerate(model.names)]
    k = len(model.vectors)
    schema = ", ".join(["feature string", *(f"pc{i + 1}_loading double" for i in range(k)), *(f"ev{i + 1} double" for i in range(k))])
    return df.sparkSession.createDataFrame(rows, schema)
