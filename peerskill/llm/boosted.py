"""Quality classifier: gradient-boosted trees on feature histograms, flattened to arrays for vectorised traversal.

Training runs in numpy on a bounded, documented sample of labelled rows; scoring runs over every document in Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, written
from .quality_rules import labelled
from .stats import FEATURES, counted, features

#: Most labelled rows that the trees are fitted on (those with the smallest hash of doc_id).
FIT_ROWS = 20_000


@dataclass
class Forest:
    """All trees in flat arrays: node i tests ``feature[i] < threshold[i]`` and goes to ``left[i]`` or ``left[i] + 1``; a leaf has
    feature -1 and adds ``value[i]``.  ``root`` has the first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves: all rows walk down one tree at a time, a level per step."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for r in self.root:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] >= self.threshold[at]
                at = np.where(f < 0, at, self.left[at] + right)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0,
        least: float = 2.0) -> Forest:
    """Logistic boosting with second-order gains on histograms of binned features.  Without rows, or with one class, the forest
    is the constant prior (one row of each class is added to the counts, so that it is never 0 or 1)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, k = x.shape if x.ndim == 2 else (0, 0)
    prior = (y.sum() + 1.0) / (n + 2.0)
    start = float(np.log(prior / (1 - prior)))
    feat, thr, left, value, root = [], [], [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(k)], axis=1)  # x >= edge[b] iff binned > b
        margin = np.full(n, start)
        for _ in range(trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            first = len(feat)
            root.append(first)
            feat.append(-1), thr.append(0.0), left.append(0), value.append(0.0)
            at = np.full(n, first)
            level = [first]
            for d in range(depth + 1):
                place = {node: i for i, node in enumerate(level)}
                slot = np.full(len(feat), -1)
                slot[level] = np.arange(len(level))
                s = slot[at]
                live = s >= 0
                gs = np.bincount(s[live], g[live], len(level))
                hs = np.bincount(s[live], h[live], len(level))
                best = [(1e-6, -1, 0)] * len(level)
                if d < depth:
                    for j in range(k):
                        width = len(edges[j]) + 1
                        key = s[live] * width + binned[live, j]
                        gj = np.cumsum(np.bincount(key, g[live], len(level) * width).reshape(-1, width), axis=1)[:, :-1]
                        hj = np.cumsum(np.bincount(key, h[live], len(level) * width).reshape(-1, width), axis=1)[:, :-1]
                        if not gj.shape[1]:
                            continue
                        gain = gj**2 / (hj + l2) + (gs[:, None] - gj) ** 2 / (hs[:, None] - hj + l2) - (gs**2 / (hs + l2))[:, None]
                        gain[(hj < least) | (hs[:, None] - hj < least)] = -1
                        top = gain.argmax(axis=1)
                        for i in range(len(level)):
                            if gain[i, top[i]] > best[i][0]:
                                best[i] = (gain[i, top[i]], j, int(top[i]))
                nxt = []
                for node, i in place.items():
                    _, j, b = best[i]
                    value[node] = float(rate * gs[i] / (hs[i] + l2))
                    if j >= 0:
                        feat[node], thr[node], left[node] = j, float(edges[j][b]), len(feat)
                        for _side in (0, 1):
                            nxt.append(len(feat))
                            feat.append(-1), thr.append(0.0), left.append(0), value.append(0.0)
                        own = at == node
                        at[own] = left[node] + (binned[own, j] > b)
                if not nxt:
                    break
                level = nxt
            margin += np.asarray(value)[at]
    return Forest(np.array(feat, np.int64), np.array(thr, float), np.array(left, np.int64), np.array(value, float), np.array(root, np.int64), depth, start)


def fitted(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """Forest fitted on labelled rows whose crc32(doc_id as text) mod 4 is not 2; features are statistics of the text only."""
    own = labels.where(F.col("doc_id").isNotNull()).where(crc_mod("doc_id", 4) != 2)
    pdf = labelled(stats, own, rows, "trees").toPandas()
    return fit(pdf[FEATURES].to_numpy(), pdf["good"].to_numpy(float))


def scored(stats: DataFrame, forest: Forest, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``stats``."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": forest.score(pdf[FEATURES].to_numpy(float))})

    out = features(stats).select("doc_id", *FEATURES).mapInPandas(run, "doc_id long, score double")
    return out.select(
        "doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text for quality.  Null and empty texts get the score of their (all zero) statistics; repeated rows each get a
    row; a null doc_id is never held out.  With no usable labels every score is the prior 0.5."""
    stats = written(counted(docs), "classifier_stats")
    return scored(stats, fitted(stats, labels))
