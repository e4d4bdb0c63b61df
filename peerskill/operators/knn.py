"""KNN vectors and the exact distributed peer search (A-9, J-8..J-10, W-1..W-3, E-3).

Plan of ``nearest_peers``:

Targets outside the population (or a given set of them) use the pivot index of
``pivot``.  A population searched by its own members:

1. hash every user into one of B blocks (``n_blocks``);
2. form the block pairs i <= j, each row copied to its B pairs;
3. one task per block pair runs the kernel ``distance.topk_block`` and emits
   only the k best per target plus the pair's max distance (never all pairs);
4. a window partitioned by target (at most k*B rows each) keeps the global
   top k and the population-wide max distance.

No cross join, no broadcast of the population, no collect; each task's work
is bounded by (WIDE x block_rows)^2 whatever N is.  Ties are broken by
(distance rounded to 1e-9, peer key).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism as _parallelism

from ..config import TAGS, VECTOR_TAG_FEATURES, VECTOR_USER_FEATURES, KnnConfig
from ..functions.distance import topk_block


# A-9 ------------------------------------------------------------------------

def vector_dims() -> list[str]:
    """Names of the 82 coordinates, feature-major (V-1)."""
    return [f"{f}__{t}" for f in VECTOR_TAG_FEATURES for t in TAGS] + list(VECTOR_USER_FEATURES)


def knn_vectors(user_tag: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """One ``array<double>`` per user: 4 features x 20 tags + 2 user-level,
    missing tag -> 0.  One hash aggregate with 82 conditional maxima (what a
    pivot with an explicit value list compiles to).

    V-2 option: with ``fallback`` = (user_key, global_acceptance,
    global_difficulty) (A-23), an unattempted tag takes the user's global
    acceptance / difficulty instead of 0 (specialization and volume stay 0)."""
    fb_for = {"acceptance_rate": "global_acceptance", "difficulty_score": "global_difficulty"}
    cells = {}
    aggs = []
    for f in VECTOR_TAG_FEATURES:
        for t in TAGS:
            name = f"_{f}__{t}"
            cells[name] = f
            aggs.append(F.max(F.when(F.col("tag") == t, F.col(f))).cast("double").alias(name))
    for f in VECTOR_USER_FEATURES:
        aggs.append(F.max(F.col(f)).cast("double").alias(f"_{f}"))
    wide = user_tag.groupBy("user_key").agg(*aggs)
    if fallback is not None:
        wide = wide.join(fallback.select("user_key", *fb_for.values()), "user_key", "left")

    def cell(name):
        f = cells.get(name)
        if fallback is not None and f in fb_for:
            return F.coalesce(F.col(name), F.col(fb_for[f]), F.lit(0.0))
        return F.coalesce(F.col(name), F.lit(0.0))

    coords = [cell(f"_{f}__{t}") for f in VECTOR_TAG_FEATURES for t in TAGS]
    coords += [F.coalesce(F.col(f"_{f}"), F.lit(0.0)) for f in VECTOR_USER_FEATURES]
    return wide.select("user_key", F.array(*coords).alias("vec"))


# J-8 / W-1..W-3 ---------------------------------------------------------------

_CAND_SCHEMA = "target_key long, peer_key long, distance double, block_max double"


#: A block has up to this many times ``block_rows`` rows where the block pairs keep every core busy all the same: vectors and candidates are
#: shuffled once per block, so fewer blocks shuffle less.  The kernel's memory does not grow with it, only the vectors of a pair.
WIDE = 4


def n_blocks(spark, n: int, block_rows: int) -> int:
    """Blocks of ``n`` rows: of ``block_rows`` rows as long as these are few, then of more rows (at most WIDE x block_rows), but at least
    enough that the B^2 block pairs keep every core busy (B^2 >= 2 x default parallelism, 8 x before blocks become wider)."""
    par, rows = _parallelism(spark), max(1, block_rows)
    by_cores = math.ceil(math.sqrt(2 * par))
    by_size = max(math.ceil(n / (WIDE * rows)), min(math.ceil(n / rows), 2 * by_cores))
    return max(1, min(max(by_size, by_cores), max(1, n)))


def _n_blocks(vectors: DataFrame, block_rows: int) -> int:
    return n_blocks(vectors.sparkSession, vectors.count(), block_rows)  # one scalar; sizes the block grid


#: Stands for a null key in the kernel and in its results.
_NO_KEY = np.iinfo(np.int64).min


def vector_matrix(col: pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column as one float64 matrix, filled chunk by chunk (no object per row)."""
    sizes = {n for c in col.chunks for n in pc.unique(pc.list_value_length(c)).to_pylist()}
    if len(sizes) != 1 or None in sizes:
        raise ValueError(f"vectors must have one length and must not be null: {sorted(map(str, sizes))}")
    out, at = np.empty((len(col), sizes.pop())), 0
    for c in col.chunks:
        out[at:at + len(c)] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), out.shape[1])
        at += len(c)
    return out


def _pair_topk(k: int, metric: str):
    """Kernel of the symmetric block-pair search: the group holds block i and
    block j (i <= j; one copy when i == j); emits the k best of block i among
    block j and, when i != j, of block j among block i."""
    def fn(rows: pa.Table) -> pa.Table:
        bi, bj = rows["pi"][0].as_py(), rows["pj"][0].as_py()
        blk, key, grp = (rows[c].fill_null(_NO_KEY).to_numpy() if c != "blk" else rows[c].to_numpy() for c in ("blk", "user_key", "grp"))
        vec = vector_matrix(rows["vec"])
        a, b = ((vec[of], key[of], grp[of]) for of in (blk == bi, blk == bj))
        del vec
        found = [topk_block(*t, *p, k, metric) for t, p in ([(a, b)] if bi == bj else [(a, b), (b, a)]) if len(t[1]) and len(p[1])]
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.table(dict(zip(("target_key", "peer_key", "distance", "block_max"), map(np.concatenate, zip(none, *found)))))

    return fn


def self_knn_candidates(vectors: DataFrame, cfg: KnnConfig = KnnConfig(), n_blocks: int | None = None,
                        group_col: str | None = None) -> DataFrame:
    """Per-block-pair candidates when every row is both target and population
    (J-9: the all-pairs leave-one-out join, self excluded by the group mask).

    Distances are symmetric, so only block pairs i <= j are formed: a row of
    block b is copied to the B pairs (min(b, j), max(b, j)); the shuffle is
    N * B rows instead of 2 * N * B, and each pair is computed by one task."""
    b = n_blocks or _n_blocks(vectors, cfg.block_rows)
    bid = F.pmod(F.xxhash64(F.col("user_key")), F.lit(b)).cast("int")
    grp = (F.col(group_col) if group_col else F.col("user_key")).cast("long").alias("grp")
    base = vectors.select("user_key", "vec", grp, bid.alias("blk"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(b - 1)),
                        lambda j: F.struct(F.least(F.col("blk"), j).alias("pi"), F.greatest(F.col("blk"), j).alias("pj")))
    rep = base.select("*", F.explode(pairs).alias("pr")).select("user_key", "vec", "grp", "blk", "pr.pi", "pr.pj")
    return rep.groupBy("pi", "pj").applyInArrow(_pair_topk(cfg.k, cfg.metric), _CAND_SCHEMA)


def nearest_peers(targets: DataFrame, population: DataFrame | None = None, cfg: KnnConfig = KnnConfig(),
                  n_blocks: int | None = None, group_col: str | None = None) -> DataFrame:
    """E-3: peers(target_key, peer_key, rank, distance, similarity, display_similarity).

    similarity          = (1 - (d - d_first) / (d_last - d_first)) * 100, range 1 if equal (W-2)
    display_similarity  = max(0, 1 - d / d_max_all) * 100, 100 when d_max_all = 0 (W-3, V-7)
    Kept at full precision; round in sinks only.  Without ``population`` the
    targets are each other's population (symmetric block pairs); with one, each
    target is searched in it by the pivot index, a row of its own key left out."""
    if population is None:
        cand = self_knn_candidates(targets, cfg, n_blocks, group_col)
    else:
        from .pivot import build_index, pivot_candidates

        cand = pivot_candidates(targets, build_index(population, cfg, group_col), cfg, group_col)
    w = Window.partitionBy("target_key").orderBy(F.round("distance", 9), "peer_key")
    ranked = (
        cand.withColumn("d_max_all", F.max("block_max").over(Window.partitionBy("target_key")))
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= cfg.k)
    )
    wt = Window.partitionBy("target_key")
    d_first, d_last = F.min("distance").over(wt), F.max("distance").over(wt)
    rng = F.when(d_last > d_first, d_last - d_first).otherwise(F.lit(1.0))
    return ranked.select(
        "target_key", "peer_key", F.col("rank").cast("int").alias("rank"), "distance",
        ((F.lit(1.0) - (F.col("distance") - d_first) / rng) * 100.0).alias("similarity"),
        F.when(F.col("d_max_all") > 0,
               F.greatest(F.lit(0.0), F.lit(1.0) - F.col("distance") / F.col("d_max_all")) * 100.0)
        .otherwise(F.lit(100.0)).alias("display_similarity"),
    )


# M-21 -------------------------------------------------------------------------------

def knn_classify(targets: DataFrame, population: DataFrame | None, labels: DataFrame, label_col: str, fold_col: str,
                 cfg: KnnConfig = KnnConfig()) -> DataFrame:
    """Cross-validated KNN classification: each row's k nearest rows outside
    its own fold vote; the most frequent label wins, the smallest label on
    ties.  Without ``population`` the targets are searched among themselves."""
    of = lambda df: df.select("user_key", "vec", fold_col)
    peers = nearest_peers(of(targets), None if population is None else of(population), cfg, group_col=fold_col)
    lab = labels.select(F.col("user_key").alias("peer_key"), F.col(label_col).alias("_lab"))
    votes = peers.join(lab, "peer_key").groupBy("target_key", "_lab").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy("target_key").agg(F.max(F.struct(F.col("_n"), (-F.col("_lab")).alias("_neg"))).alias("_b"))
    return best.select("target_key", (-F.col("_b._neg")).alias("predicted")).join(
        targets.select(F.col("user_key").alias("target_key"), F.col(label_col).alias("actual"),
                       F.col(fold_col).alias("fold")), "target_key")
