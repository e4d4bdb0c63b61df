"""The pivot index against all pairs: targets outside the population, three metrics, odd vectors, and how many blocks are met."""

import numpy as np
import pytest

from peerskill.config import KnnConfig
from peerskill.functions.distance import METRICS, exact_rows
from peerskill.operators import knn as K
from peerskill.operators import pivot as P


def frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, m)], "user_key long, vec array<double>")


@pytest.mark.parametrize("metric", METRICS)
def test_targets_outside_equal_all_pairs(spark, metric):
    rng = np.random.default_rng(2)
    pop = np.vstack([rng.normal(c, 0.3, (60, 5)) for c in (0, 4, -3)] + [np.zeros((3, 5)), np.full((3, 5), 1e-9), np.ones((20, 5))])
    pid = rng.permutation(len(pop)) + 5
    t = np.vstack([pop[:20], rng.normal(0, 3, (15, 5)), np.zeros((2, 5)), np.ones((2, 5))])
    tid = np.r_[pid[:20], 1000 + np.arange(19)]  # the first are rows of the population
    cfg = KnnConfig(k=7, metric=metric, block_rows=16)
    got = K.nearest_peers(frame(spark, tid, t), frame(spark, pid, pop), cfg).toPandas()
    assert len(got) == 7 * len(tid)
    for i, key in enumerate(tid):
        d = exact_rows(np.repeat(t[i:i + 1], len(pop), 0), pop, metric)
        ok = np.flatnonzero(pid != key)
        best = ok[np.lexsort((pid[ok], np.round(d[ok], 9)))][:7]
        own = got[got.target_key == key].sort_values("rank")
        assert list(own.peer_key) == list(pid[best]) and np.allclose(own.distance, d[best])
        far = d[ok].max()
        assert np.allclose(own.display_similarity, np.maximum(0, 1 - d[best] / far) * 100)


def test_few_blocks_are_met_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (40, 20))
    pop = centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.2, (6000, 20))
    t = centres[rng.integers(0, 40, 300)] + rng.normal(0, 0.2, (300, 20))
    cfg = KnnConfig(k=10)
    index = P.build_index(frame(spark, np.arange(6000), pop), cfg)
    met = P.pivot_candidates(frame(spark, 10_000 + np.arange(300), t), index, cfg).select("target_key", "blk").distinct().count()
    assert len(index.rows) >= 20 and index.rows.sum() == 6000
    assert met < 0.5 * 300 * len(index.rows), met / (300 * len(index.rows))


def test_candidates_grow_with_units_not_with_blocks(spark):
    rng = np.random.default_rng(6)
    pop, t = rng.normal(size=(1500, 12)), rng.normal(size=(40, 12))  # nothing to prune: most blocks are met
    cfg = KnnConfig(k=20, block_rows=32)
    index = P.build_index(frame(spark, np.arange(1500), pop), cfg)
    assert len(index.rows) >= 40 and index.rows.sum() == 1500
    units = len(set(index.unit.tolist()))
    assert units < len(index.rows) / 2 and np.bincount(index.unit, index.rows).max() <= index.unit_rows
    rows = P.pivot_candidates(frame(spark, 10_000 + np.arange(40), t), index, cfg)
    assert rows.count() <= 40 * units * 20  # one k per block before: about 40 * 47 * 20


def test_groups_small_and_empty_populations(spark):
    ids = np.arange(12)
    m = np.random.default_rng(0).normal(size=(12, 3))
    v = frame(spark, ids, m).selectExpr("*", "user_key % 3 as fold")
    got = K.nearest_peers(v, v, KnnConfig(k=50), group_col="fold").toPandas()
    assert got.groupby("target_key").size().eq(8).all() and (got.target_key % 3 != got.peer_key % 3).all()
    again = K.nearest_peers(v, None, KnnConfig(k=50), group_col="fold").toPandas()
    order = ["target_key", "rank"]
    assert got.sort_values(order).peer_key.tolist() == again.sort_values(order).peer_key.tolist()
    assert K.nearest_peers(v, v.limit(0), KnnConfig(k=5)).count() == 0
    assert K.nearest_peers(v.limit(0), v, KnnConfig(k=5)).count() == 0
