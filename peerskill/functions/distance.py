"""Distance metrics (F-12, X-1) as Column expressions and as NumPy kernels.

The Column versions work on two ``array<double>`` columns and are used for
small, bounded joins (target x its k peers).  The NumPy kernels are used
inside the block-pair KNN tasks, where a block of targets meets a block of
the population.  Unknown metric names fall back to euclidean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan", "cosine")
#: Distances that ``topk_block`` holds at once (one array of so many numbers and a few masks).
CHUNK_CELLS = 1 << 19


def _pairs(a: Column, b: Column, fn) -> Column:
    return F.aggregate(F.zip_with(a, b, fn), F.lit(0.0), lambda acc, x: acc + x)


def distance_col(a: Column, b: Column, metric: str = "euclidean") -> Column:
    if metric == "manhattan":
        return _pairs(a, b, lambda x, y: F.abs(x - y))
    if metric == "cosine":
        dot = _pairs(a, b, lambda x, y: x * y)
        na = F.sqrt(_pairs(a, a, lambda x, y: x * y))
        nb = F.sqrt(_pairs(b, b, lambda x, y: x * y))
        return F.lit(1.0) - dot / F.greatest(na * nb, F.lit(1e-12))
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def distance_matrix(t: np.ndarray, p: np.ndarray, metric: str = "euclidean", chunk: int = 32) -> np.ndarray:
    """|t| x |p| distances, computed in row chunks to bound memory."""
    out = np.empty((t.shape[0], p.shape[0]), dtype=np.float64)
    if metric == "cosine":
        pn = np.linalg.norm(p, axis=1)
    for s in range(0, t.shape[0], chunk):
        tc = t[s:s + chunk]
        if metric == "manhattan":
            out[s:s + chunk] = np.abs(tc[:, None, :] - p[None, :, :]).sum(axis=2)
        elif metric == "cosine":
            tn = np.linalg.norm(tc, axis=1)
            den = np.maximum(tn[:, None] * pn[None, :], 1e-12)
            out[s:s + chunk] = 1.0 - (tc @ p.T) / den
        else:
            d = tc[:, None, :] - p[None, :, :]
            out[s:s + chunk] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def exact_rows(t: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distances of t[i] to p[i] (row-aligned pairs), computed directly."""
    if metric == "manhattan":
        return np.abs(t - p).sum(axis=1)
    if metric == "cosine":
        den = np.maximum(np.linalg.norm(t, axis=1) * np.linalg.norm(p, axis=1), 1e-12)
        return 1.0 - (t * p).sum(axis=1) / den
    d = t - p
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _pair_distances(t: np.ndarray, p: np.ndarray, ri: np.ndarray, ci: np.ndarray, metric: str,
                    step: int = 1 << 16) -> np.ndarray:
    """Distances of the pairs (t[ri], p[ci]), in pieces of ``step`` pairs to bound memory."""
    parts = [exact_rows(t[ri[s:s + step]], p[ci[s:s + step]], metric) for s in range(0, ri.shape[0], step)]
    return np.concatenate(parts) if parts else np.array([])


def needed_rows(p: np.ndarray, pid: np.ndarray, pg: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows of ``p`` that can be among the k smallest ids of
    their vector for some target group: equal vectors are equally far from every
    target and ties are ordered by id, so of each vector only a few rows count.

    With g* the most frequent group in a vector's first 2k rows (by id), every
    other group has at most k of them, so a target of another group finds k rows
    there; a target of g* needs the first k rows outside g*."""
    n = p.shape[0]
    rows = np.ascontiguousarray(p + 0.0).view(np.dtype((np.void, p.dtype.itemsize * p.shape[1]))).ravel()  # + 0.0: -0.0 is 0.0
    _, vec, count = np.unique(rows, return_inverse=True, return_counts=True)
    vec = vec.ravel()
    if count.max(initial=0) <= 2 * k:
        return np.arange(n)
    keep = [np.flatnonzero(count[vec] <= 2 * k)]
    order = np.lexsort((pid, vec))
    ends = np.cumsum(count)
    for v in np.flatnonzero(count > 2 * k):
        of = order[ends[v] - count[v]:ends[v]]
        groups, n_of = np.unique(pg[of[:2 * k]], return_counts=True)
        other = of[2 * k:][pg[of[2 * k:]] != groups[np.argmax(n_of)]]
        keep += [of[:2 * k], other[:k]]
    return np.sort(np.concatenate(keep))


def _kth_bound(x: np.ndarray, k: int) -> np.ndarray:
    """A number not below the k-th smallest of each row of ``x`` (exactly it where the rows are short): the k-th smallest of the minima of
    about 4k sets of columns, which costs one pass instead of a selection over the whole row."""
    n = x.shape[1]
    width = n // max(4 * k, 64)
    if width < 2:
        return np.partition(x, k - 1, axis=1)[:, k - 1]
    sets = n // width
    least = x[:, :sets * width].reshape(x.shape[0], width, sets).min(axis=1)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1]
    short = np.flatnonzero(~np.isfinite(bound))  # fewer than k sets with a valid column
    if short.size:
        bound[short] = np.partition(x[short], k - 1, axis=1)[:, k - 1]
    return bound


def topk_block(t: np.ndarray, tid: np.ndarray, tg: np.ndarray, p: np.ndarray, pid: np.ndarray, pg: np.ndarray,
               k: int, metric: str = "euclidean", chunk: int | None = None):
    """Exact k nearest of every row of ``t`` among ``p`` (pairs with equal
    group excluded), ordered by (distance rounded to 1e-9, peer id), plus the
    exact max distance per row.  Fully vectorised per chunk of target rows.

    Euclidean candidates come from the BLAS form |b|^2 - 2ab (the squared
    distance less |a|^2, which is the same for a whole row) with a guard band
    wider than its rounding error (so every true top-k member and every 1e-9
    tie is a candidate), then the candidates' distances are recomputed
    directly: the result equals a direct computation.  Rows of equal vectors
    that cannot be among any target's k nearest are left out first.  By
    default a chunk has at most CHUNK_CELLS distances, so the temporary arrays
    do not grow with ``p``."""
    chunk = chunk or max(1, min(256, CHUNK_CELLS // max(1, p.shape[0])))
    if p.shape[0] and k:
        need = needed_rows(p, pid, pg, k)
        p, pid, pg = p[need], pid[need], pg[need]
    out_t, out_p, out_d, out_m = [], [], [], []
    kcap = min(k, p.shape[0])
    if kcap == 0:
        e = np.array([], dtype=np.int64)
        return e, e, np.array([]), np.array([])
    if metric == "euclidean":
        pn2 = np.einsum("ij,ij->i", p, p)
        sides = np.ascontiguousarray(np.vstack([-2.0 * p.T, pn2]))
        tn2 = np.einsum("ij,ij->i", t, t)
        error = 64.0 * np.finfo(np.float64).eps * (t.shape[1] + 2) * (tn2 + pn2.max())
    shared = np.isin(tg, pg)  # targets with pairs to leave out
    for s in range(0, t.shape[0], chunk):
        tc, tidc, tgc = t[s:s + chunk], tid[s:s + chunk], tg[s:s + chunk]
        if metric == "euclidean":
            x = np.hstack([tc, np.ones((tc.shape[0], 1))]) @ sides
        else:
            x = distance_matrix(tc, p, metric, max(1, min(32, CHUNK_CELLS * 8 // max(1, p.size))))
        kk, same = np.full(tc.shape[0], kcap), None
        if shared[s:s + chunk].any():
            same = tgc[:, None] == pg[None, :]
            kk = np.minimum(kcap, p.shape[0] - same.sum(axis=1))
            np.copyto(x, -np.inf, where=same)
        top = x.max(axis=1)
        if same is not None:
            np.copyto(x, np.inf, where=same)
        kth = _kth_bound(x, kcap)                                           # inf when fewer valid than kcap
        if metric == "euclidean":
            e, n2 = error[s:s + chunk], tn2[s:s + chunk]
            near = np.square(np.sqrt(np.maximum(kth + n2 + e, 0.0)) + 2e-9) + e - n2
            least = top - 2.0 * e
        else:
            near, least = kth + 2e-9, top - 1e-12
        cand = x <= near[:, None]
        far = x >= least[:, None]
        if same is not None:
            cand &= ~same
            far &= ~same
        ri, ci = np.divmod(np.flatnonzero(cand), p.shape[0])
        if ri.size == 0:                     # no valid peer in this block for any row
            continue
        exact = _pair_distances(tc, p, ri, ci, metric)
        order = np.lexsort((pid[ci], np.round(exact, 9), ri))
        ri, ci, exact = ri[order], ci[order], exact[order]
        starts = np.r_[0, np.flatnonzero(np.diff(ri)) + 1]
        first = np.zeros(tc.shape[0], dtype=np.int64)
        first[ri[starts]] = starts
        keep = (np.arange(ri.shape[0]) - first[ri]) < kk[ri]
        ri, ci, exact = ri[keep], ci[keep], exact[keep]
        # exact max distance: only points whose upper bound can reach the max
        mi, mj = np.divmod(np.flatnonzero(far), p.shape[0])
        dmax = np.full(tc.shape[0], -np.inf)
        np.maximum.at(dmax, mi, _pair_distances(tc, p, mi, mj, metric))
        out_t.append(tidc[ri])
        out_p.append(pid[ci])
        out_d.append(exact)
        out_m.append(dmax[ri])
    if not out_t:
        e = np.array([], dtype=np.int64)
        return e, e, np.array([]), np.array([])
    return np.concatenate(out_t), np.concatenate(out_p), np.concatenate(out_d), np.concatenate(out_m)
