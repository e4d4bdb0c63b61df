"""Block-pair KNN equals brute force, with many blocks and ties."""

import numpy as np
import pandas as pd

from peerskill.config import KnnConfig
from peerskill.operators import knn as K


def _brute(ids, m, k):
    rows = []
    for i, t in enumerate(ids):
        d = np.sqrt(((m - m[i]) ** 2).sum(axis=1))
        cand = [(round(d[j], 9), ids[j], d[j]) for j in range(len(ids)) if ids[j] != t]
        cand.sort()
        top = cand[:k]
        dmax = max(c[2] for c in cand)
        d_first, d_last = top[0][2], top[-1][2]
        rng = d_last - d_first if d_last > d_first else 1.0
        for r, (_, p, dist) in enumerate(top, 1):
            rows.append((t, p, r, dist, (1 - (dist - d_first) / rng) * 100,
                         max(0.0, 1 - dist / dmax) * 100 if dmax > 0 else 100.0))
    return pd.DataFrame(rows, columns=["target_key", "peer_key", "rank", "distance", "similarity",
                                       "display_similarity"])


def test_block_knn_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n, dim, k = 90, 6, 7
    ids = np.arange(1000, 1000 + n)
    m = rng.integers(0, 3, size=(n, dim)).astype(float)   # many exact ties
    m[5] = m[6]                                            # identical vectors
    vec = spark.createDataFrame(
        [(int(i), [float(x) for x in row]) for i, row in zip(ids, m)], "user_key long, vec array<double>")
    cfg = KnnConfig(k=k, block_rows=16)                    # 6 blocks -> 36 block pairs
    got = K.nearest_peers(vec, vec, cfg).toPandas().sort_values(["target_key", "rank"]).reset_index(drop=True)
    exp = _brute(ids, m, k).sort_values(["target_key", "rank"]).reset_index(drop=True)
    assert list(got["peer_key"]) == list(exp["peer_key"])
    assert np.allclose(got["distance"], exp["distance"])
    assert np.allclose(got["similarity"], exp["similarity"])
    assert np.allclose(got["display_similarity"], exp["display_similarity"])


def test_all_distances_equal(spark):
    vec = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "user_key long, vec array<double>")
    got = K.nearest_peers(vec, vec, KnnConfig(k=3, block_rows=2)).toPandas()
    assert (got["distance"] == 0).all()
    assert (got["display_similarity"] == 100.0).all()     # V-7: no division by zero
    assert (got["similarity"] == 100.0).all()
    assert got.groupby("target_key").size().eq(3).all()


def test_topk_block_kernel_matches_sort():
    """The vectorised block kernel against a plain sort, many random shapes."""
    from peerskill.functions.distance import exact_rows, topk_block

    rng = np.random.default_rng(11)
    for trial in range(60):
        nt, npop, dim = rng.integers(1, 40), rng.integers(1, 60), rng.integers(1, 6)
        k = int(rng.integers(1, 70))
        scale = [1.0, 1e-6, 1e6][trial % 3]
        t = rng.integers(0, 3, size=(nt, dim)).astype(float) * scale
        p = rng.integers(0, 3, size=(npop, dim)).astype(float) * scale
        tid = np.arange(nt, dtype=np.int64)
        pid = rng.permutation(npop).astype(np.int64) + 1000
        tg = rng.integers(0, 4, nt).astype(np.int64)
        pg = rng.integers(0, 4, npop).astype(np.int64)
        got_t, got_p, got_d, got_m = topk_block(t, tid, tg, p, pid, pg, k, chunk=7)
        for i in range(nt):
            ok = pg != tg[i]
            if not ok.any():
                assert not (got_t == tid[i]).any()
                continue
            d = np.sqrt(((p[ok] - t[i]) ** 2).sum(axis=1))
            order = np.lexsort((pid[ok], np.round(d, 9)))[:k]
            sel = got_t == tid[i]
            assert list(got_p[sel]) == list(pid[ok][order])
            assert np.allclose(got_d[sel], d[order])
            assert np.allclose(got_m[sel], d.max())


def test_equal_vectors_with_groups_match_brute_force():
    from peerskill.functions.distance import exact_rows, topk_block

    rng = np.random.default_rng(3)
    for n, groups, k, metric in ((300, 3, 4, "euclidean"), (300, 300, 5, "manhattan"), (200, 2, 7, "cosine"), (50, 1, 3, "euclidean")):
        v = rng.integers(0, 2, (4, 3)).astype(float)[rng.integers(0, 4, n)] + 0.5
        ids = rng.permutation(n).astype(np.int64)
        g = ids.copy() if groups == n else np.where(rng.random(n) < 0.8, 0, rng.integers(0, groups, n)).astype(np.int64)
        t, p, d, m = topk_block(v, ids, g, v, ids, g, k, metric)
        full = np.array([exact_rows(np.repeat(v[i:i + 1], n, 0), v, metric) for i in range(n)])
        for i in range(n):
            ok = np.flatnonzero(g != g[i])
            best = ok[np.lexsort((ids[ok], np.round(full[i, ok], 9)))][:k]
            assert list(p[t == ids[i]]) == list(ids[best])
            if ok.size:
                assert np.allclose(m[t == ids[i]], full[i, ok].max())


def test_many_equal_vectors_stay_cheap():
    import time

    from peerskill.functions.distance import exact_rows, topk_block

    n = 8192
    v, ids = np.ones((n, 82)), np.arange(n)
    t0 = time.time()
    t, p, d, m = topk_block(v, ids, ids, v, ids, ids, 50)
    assert t.shape[0] == n * 50 and set(p[t == 0]) == set(range(1, 51)) and time.time() - t0 < 20


def test_distance_columns_equal_the_kernels(spark):
    from pyspark.sql import functions as F

    from peerskill.functions.distance import METRICS, distance_col, exact_rows

    rng = np.random.default_rng(1)
    a, b = rng.random((20, 6)), rng.random((20, 6))
    a[0] = 0.0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))],
                               "i int, a array<double>, b array<double>")
    for metric in METRICS:
        got = [r.d for r in df.select("i", distance_col(F.col("a"), F.col("b"), metric).alias("d")).orderBy("i").collect()]
        assert np.allclose(got, exact_rows(a, b, metric))


def test_blocks_become_wider_with_the_population(spark):
    assert K.n_blocks(spark, 610_000, 8192) == 19  # 75 before: so many times each vector was shuffled, with k candidates each time
    assert K.n_blocks(spark, 8 * 610_000, 8192) == 149
    assert K.n_blocks(spark, 30, 8192) == 3 and K.n_blocks(spark, 0, 8192) == 1


def test_temporary_arrays_do_not_grow_with_the_block():
    import tracemalloc

    from peerskill.functions.distance import topk_block

    peaks = []
    for n in (2_000, 16_000):
        p, ids = np.random.default_rng(1).normal(size=(n, 10)), np.arange(n)
        tracemalloc.start()
        topk_block(p[:500], ids[:500], ids[:500], p, ids, ids, 5)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0], peaks  # 8 x before


def test_kernel_is_one_pass_over_the_distances(monkeypatch):
    """The k-th distance is bounded by sets of columns: no selection over whole rows, and the bound holds with few valid columns."""
    from peerskill.functions import distance as D

    rng = np.random.default_rng(5)
    x = rng.random((40, 4000))
    x[1, 60:] = np.inf
    x[2] = np.nan
    x[2, :200] = rng.random(200)
    bound = D._kth_bound(x, 50)
    for row, b in zip(x, bound):
        assert b >= np.sort(row)[49] and (row <= b).sum() <= 200
    widest, plain = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kw: widest.append(a.shape[1]) or plain(a, *args, **kw))
    p, ids = rng.normal(size=(6000, 8)), np.arange(6000)
    t, q, d, m = D.topk_block(p[:100], ids[:100], ids[:100] % 3, p, ids, ids % 3, 20)
    assert max(widest) < 600  # 6000 before
    for i in range(0, 100, 9):
        ok = np.flatnonzero(ids % 3 != i % 3)
        full = D.exact_rows(np.repeat(p[i:i + 1], len(ok), 0), p[ok], "euclidean")
        assert list(q[t == i]) == list(ok[np.lexsort((ok, np.round(full, 9)))][:20]) and np.isclose(m[t == i][0], full.max())


def test_blocks_come_as_one_matrix_without_an_object_a_row():
    import tracemalloc

    import pyarrow as pa
    import pytest

    n, dim = 4000, 82
    flat = np.random.default_rng(2).random(n * dim)
    col = pa.chunked_array([pa.ListArray.from_arrays(np.arange(0, n * dim // 2 + 1, dim, dtype=np.int32), flat[i * n * dim // 2:(i + 1) * n * dim // 2]) for i in (0, 1)])
    tracemalloc.start()
    got = K.vector_matrix(col.slice(5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == flat.reshape(n, dim)[5:]).all() and peak < 1.1 * got.nbytes + 100_000
    for odd in ([[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            K.vector_matrix(pa.chunked_array([odd]))


def test_a_user_without_key_is_searched_and_keeps_long_keys_whole(spark):
    big = (1 << 60) + 1
    vec = spark.createDataFrame([(None, [0.0]), (big, [1.0]), (3, [3.0])], "user_key long, vec array<double>")
    got = {(r["target_key"], r["peer_key"]) for r in K.nearest_peers(vec, cfg=KnnConfig(k=1), n_blocks=1).collect()}
    none = -(1 << 63)
    assert got == {(none, big), (big, none), (3, big)}
