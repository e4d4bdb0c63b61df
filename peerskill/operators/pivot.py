"""Exact nearest peers of targets that need not be in the population (J-8, E-3), by a pivot index.

The population is cut into blocks of rows that share their nearest pivot; each block keeps the least and the greatest distance of its rows
from the pivot.  By the triangle inequality a target at distance d from the pivot is at least max(d - greatest, least - d) from every row
of the block and at most d + greatest.  The search has two rounds:

1. every target meets its nearest blocks until they hold more than twice k rows, and the block that may hold its farthest row;
2. with the k-th distance and the farthest distance found there, it meets the blocks that can still hold a nearer row or a farther one.

No block is left out that could change the result, so the result equals that of all pairs.  Bounds: at most ``MAX_PIVOTS`` pivots and
``MAX_BLOCKS`` + MAX_PIVOTS blocks are known to the driver and travel with the tasks.  Neighbouring blocks form a unit; a task holds one
unit and a part of the targets that meet any of its blocks, and keeps the k best of a target over all of them (in the second round only
those that are no farther than its k-th of the first), so rows grow with the units that a target meets, not with the blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KnnConfig
from ..functions.distance import distance_matrix, topk_block
from ..session import scratch_path
from .knn import n_blocks

MAX_PIVOTS, MAX_BLOCKS = 4096, 16_384
#: Least rows that a pivot should have, and a bound on the rounding errors of distances in the plans of the rounds.
CELL_ROWS, SLACK = 32, 1e-6
_TINY = 1e-6  # shorter vectors have no direction to go by under cosine


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Space:
    """What the triangle inequality is applied to: the vectors, or for cosine their directions, of which half the squared distance is the
    cosine distance."""

    metric: str

    def place(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(points, odd): odd vectors have no place in the space, nothing is known of their distances."""
        if self.metric != "cosine":
            return vec, np.zeros(len(vec), bool)
        norm = np.linalg.norm(vec, axis=1)
        return vec / np.maximum(norm, _TINY)[:, None], norm < _TINY

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return distance_matrix(a, b, "manhattan" if self.metric == "manhattan" else "euclidean", max(1, (1 << 18) // max(1, len(b))))

    def inward(self, distance: np.ndarray) -> np.ndarray:
        """Distance in the space of a distance of the metric."""
        return np.sqrt(2 * np.maximum(distance, 0)) if self.metric == "cosine" else distance


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


@dataclass
class PivotIndex:
    """blocks: user_key, vec, grp, blk, unit of the population; for each block number its pivot (-1: odd vectors), rows, distance bounds and
    unit; ``unit_rows``: rows that a unit should have."""

    blocks: DataFrame
    space: Space
    pivots: np.ndarray
    pivot: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    unit: np.ndarray
    unit_rows: int

    def bounds(self, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the distances of each target to the rows of each block, and a lower bound of its farthest one."""
        points, odd = self.space.place(vec)
        d = self.space.between(points, self.pivots)[:, self.pivot]
        lower = np.maximum(np.maximum(d - self.greatest, self.least - d), 0)
        upper = d + self.greatest
        far = np.where(self.pivot >= 0, np.maximum(d - self.least, self.greatest - d), 0)
        loose = odd[:, None] | (self.pivot < 0)[None, :]
        lower, upper, far = np.where(loose, 0, lower), np.where(loose, np.inf, upper), np.where(loose, 0, far)
        return lower, upper, far.max(axis=1, initial=0)

    def first(self, vec: np.ndarray, k: int) -> np.ndarray:
        """Mask of the blocks that each target meets in the first round."""
        lower, upper, _ = self.bounds(vec)
        order = np.argsort(lower + np.minimum(upper, 1e300) * 1e-3, axis=1, kind="stable")  # of blocks as near, the tighter one
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(lower.shape, bool)
        np.put_along_axis(out, order, before <= 2 * k, axis=1)
        out[np.arange(len(out)), np.argmax(np.where(np.isfinite(upper), upper, -1), axis=1)] = True
        return out

    def second(self, vec: np.ndarray, k: int, kth: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Mask of the blocks that are left, given the k-th nearest (inf: fewer found) and the farthest distance of the first round."""
        lower, upper, least_far = self.bounds(vec)
        kth, far = self.space.inward(kth) + SLACK, np.maximum(self.space.inward(far), least_far) - SLACK
        return ((lower <= kth[:, None]) | (upper >= far[:, None])) & ~self.first(vec, k)


def build_index(population: DataFrame, cfg: KnnConfig = KnnConfig(), group_col: str | None = None) -> PivotIndex:
    """Index of ``population`` (user_key, vec).  The pivots are the vectors of the least key hashes; their number grows with the square
    root of the rows, up to MAX_PIVOTS.  The rows of a pivot beyond ``block_rows`` are dealt into several blocks."""
    space = Space(cfg.metric)
    grp = (F.col(group_col) if group_col else F.col("user_key")).cast("long").alias("grp")
    rows = _written(population.select(F.col("user_key").cast("long").alias("user_key"), "vec", grp), "pivot_rows")
    n = rows.count()
    cell = max(CELL_ROWS, min(cfg.block_rows, math.ceil(2 * math.sqrt(n))))
    wanted = max(1, min(MAX_PIVOTS, math.ceil(n / cell)))
    sample = rows.orderBy(F.xxhash64("user_key"), "user_key").select("vec").limit(wanted).toPandas()  # at most MAX_PIVOTS vectors
    points, odd = space.place(_matrix(sample["vec"])) if len(sample) else (np.zeros((0, 1)), np.zeros(0, bool))
    pivots = np.unique(points[~odd], axis=0) if (~odd).any() else np.zeros((1, points.shape[1]))

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                at, lost = space.place(_matrix(pdf["vec"]))
                d = space.between(at, pivots)
                own = d.argmin(axis=1)
                yield pdf.assign(pivot=np.where(lost, -1, own), r=np.where(lost, 0.0, d[np.arange(len(d)), own]))

    placed = _written(rows.mapInPandas(assign, "user_key long, vec array<double>, grp long, pivot long, r double"), "pivot_placed")
    limit = max(cfg.block_rows, math.ceil(n / MAX_BLOCKS))
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("parts"))  # a row per pivot
    dealt = placed.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("user_key"), F.col("parts")).cast("int"))
    found = dealt.groupBy("pivot", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("r").alias("least"), F.max("r").alias("greatest"))
    table = found.orderBy("pivot", "part").toPandas()  # a row per block
    unit_rows = math.ceil(n / n_blocks(rows.sparkSession, n, cfg.block_rows))
    unit = units_of(table["rows"].to_numpy(np.int64), unit_rows)
    numbers = rows.sparkSession.createDataFrame(
        [(int(p), int(q), i, int(u)) for i, (p, q, u) in enumerate(zip(table["pivot"], table["part"], unit))], "pivot long, part int, blk int, unit int")
    blocks = dealt.join(F.broadcast(numbers), ["pivot", "part"]).select("user_key", "vec", "grp", "blk", "unit")
    col = lambda c, kind: table[c].to_numpy(kind)
    return PivotIndex(_written(blocks, "pivot_blocks"), space, pivots, col("pivot", int), col("rows", float), col("least", float), col("greatest", float),
                      unit, unit_rows)


def units_of(rows: np.ndarray, unit_rows: int) -> np.ndarray:
    """Unit of each block: the next one begins where a block would bring its unit above ``unit_rows``."""
    unit, own, held = np.zeros(len(rows), np.int64), 0, 0
    for i, r in enumerate(rows):
        if held and held + r > unit_rows:
            own, held = own + 1, 0
        unit[i], held = own, held + r
    return unit


_CANDIDATES = "target_key long, peer_key long, distance double, block_max double, blk int"
_SLICE = 2048  # targets of a task whose candidates are held at once


def _best_of_unit(tdf: pd.DataFrame, pdf: pd.DataFrame, k: int, metric: str):
    """(target, peer, distance, block_max, blk) of the k best rows of ``pdf`` in the blocks ``blks`` of each target, by (distance rounded to
    1e-9, peer).  Rows farther than the target's ``kth`` are left out but for the first, which carries its greatest block_max."""
    side = lambda x: (_matrix(x["vec"]), x["user_key"].to_numpy(np.int64), x["grp"].to_numpy(np.int64))
    at = pdf["blk"].to_numpy()
    order = np.argsort(at, kind="stable")
    ids, starts = np.unique(at[order], return_index=True)
    members = dict(zip(ids.tolist(), np.split(order, starts[1:])))
    pv, pid, pg = side(pdf)
    for s in range(0, len(tdf), _SLICE):
        own = tdf.iloc[s:s + _SLICE]
        tv, tid, tg = side(own)
        by_key = np.argsort(tid)
        within = own["kth"].to_numpy(float)[by_key] + SLACK
        who = np.repeat(np.arange(len(own)), own["blks"].str.len())
        met = np.concatenate(own["blks"].to_numpy())
        found = []
        for blk in np.unique(met).tolist():
            if blk in members:
                t, p = who[met == blk], members[blk]
                key, peer, d, far = topk_block(tv[t], tid[t], tg[t], pv[p], pid[p], pg[p], k, metric)
                first = np.r_[True, key[1:] != key[:-1]][:len(key)]
                near = first | (d <= within[np.searchsorted(tid, key, sorter=by_key)])
                found.append((key[near], peer[near], d[near], far[near], np.full(int(near.sum()), blk, np.int32)))
        if not found or not sum(len(x[0]) for x in found):
            continue
        key, peer, d, far, blk = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((peer, np.round(d, 9), key))
        key, peer, d, far, blk = (x[order] for x in (key, peer, d, far, blk))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[starts, len(key)])
        rank = np.arange(len(key)) - np.repeat(starts, length)
        far = np.repeat(np.maximum.reduceat(far, starts), length)
        keep = (rank == 0) | ((rank < k) & (d <= within[np.searchsorted(tid, key, sorter=by_key)]))
        yield key[keep], peer[keep], d[keep], far[keep], blk[keep]


def _meet(visits: DataFrame, index: PivotIndex, cfg: KnnConfig) -> DataFrame:
    """The k best of the visited blocks of each unit for each visit (user_key, vec, grp, kth, unit, blks)."""
    counts = visits.groupBy("unit").agg(F.ceil(F.count(F.lit(1)) / index.unit_rows).cast("int").alias("parts"))  # a row per unit
    counts = F.broadcast(_written(counts, "pivot_visits"))
    t = visits.join(counts, "unit").withColumn("part", F.pmod(F.xxhash64("user_key"), F.col("parts")).cast("int")).drop("parts")
    p = index.blocks.join(counts, "unit").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    k, metric = cfg.k, cfg.metric

    def best(tdf: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        found = [] if tdf.empty or pdf.empty else list(_best_of_unit(tdf, pdf, k, metric))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int32))
        out = [np.concatenate(x) for x in zip(none, *found)]
        return pd.DataFrame(dict(zip(("target_key", "peer_key", "distance", "block_max", "blk"), out)))

    return t.groupBy("unit", "part").cogroup(p.groupBy("unit", "part")).applyInPandas(best, _CANDIDATES)


def _visits(targets: DataFrame, masks, unit: np.ndarray) -> DataFrame:
    """A row per target and unit that has blocks of ``masks`` (a function of a frame of targets), with those blocks."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])  # blocks are numbered unit by unit

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                own = pdf.iloc[i:i + 512]
                mask = masks(own)
                who, of = np.nonzero(np.logical_or.reduceat(mask, starts, axis=1))
                if len(who):
                    row, blk = np.nonzero(mask)
                    ends = np.flatnonzero((row[1:] != row[:-1]) | (unit[blk[1:]] != unit[blk[:-1]])) + 1
                    yield own.iloc[who][["user_key", "vec", "grp", "kth"]].assign(unit=of.astype(np.int32), blks=np.split(blk.astype(np.int32), ends))

    return targets.mapInPandas(run, "user_key long, vec array<double>, grp long, kth double, unit int, blks array<int>")


def pivot_candidates(targets: DataFrame, index: PivotIndex, cfg: KnnConfig = KnnConfig(), group_col: str | None = None) -> DataFrame:
    """Candidates (target_key, peer_key, distance, block_max, blk) of ``targets`` (user_key, vec; each key once): among them are the k
    nearest rows of the population outside the target's group (default: with another key), and the greatest block_max of a target is its
    farthest distance.  An empty population gives none."""
    if not len(index.rows):
        return targets.sparkSession.createDataFrame([], _CANDIDATES)
    grp = (F.col(group_col) if group_col else F.col("user_key")).cast("long").alias("grp")
    own = _written(targets.select(F.col("user_key").cast("long").alias("user_key"), "vec", grp), "pivot_targets")
    plan, k = replace(index, blocks=None), cfg.k
    fresh = own.withColumn("kth", F.lit(math.inf))
    one = _written(_meet(_visits(fresh, lambda pdf: plan.first(_matrix(pdf["vec"]), k), index.unit), index, cfg), "pivot_first")
    rank = F.row_number().over(Window.partitionBy("target_key").orderBy("distance"))
    far = F.max("block_max").over(Window.partitionBy("target_key"))
    seen = one.select("target_key", "distance", rank.alias("rank"), far.alias("far")).where(F.col("rank") == k)
    seen = seen.select(F.col("target_key").alias("user_key"), F.col("distance").alias("kth"), "far")
    known = own.join(seen, "user_key", "left").fillna({"kth": math.inf, "far": 0.0})
    second = lambda pdf: plan.second(_matrix(pdf["vec"]), k, pdf["kth"].to_numpy(float), pdf["far"].to_numpy(float))
    two = _meet(_visits(known, second, index.unit), index, cfg)
    return one.unionByName(two)
