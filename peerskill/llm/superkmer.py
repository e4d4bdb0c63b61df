"""Super-k-mer partitioning: windows that share a minimiser travel together as one packed string.

A window is ``k`` consecutive places (words or bytes) of one text.  Its minimiser is the smallest rank among its m-grams, so equal
windows have equal minimisers and meet in one bucket.  Consecutive windows with the same minimiser form one run, whose places
are shipped once.  Ranks put grams that occur in a large share of documents last (a list of bounded size, counted over all
documents): windows that hold anything rarer are keyed by that, so the surroundings of a passage that a third of all documents share
spread over the buckets, and the runs inside the passage are equal strings, shipped once by each task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A gram is common if it is in this share of all documents; at most (grams of a mean document / share) grams can be.
COMMON_SHARE = 0.005
#: Bytes of runs that a mapper gathers before it writes them out by bucket.
FLUSH_BYTES = 24 << 20
_LAST = np.uint64(1) << np.uint64(63)
BLOB = "bucket int, payload binary"


def ranks(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Ranks of grams: their hash, with the top bit set for those in ``common`` (sorted)."""
    out = hashes >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        out = out | np.where(common[at] == hashes, _LAST, np.uint64(0))
    return out


def window_min(rank: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive ranks, by doubling."""
    n = len(rank) - w + 1
    if n <= 0:
        return rank[:0]
    out, span = rank, 1
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[w - span : w - span + n])


def runs(least: np.ndarray, valid: np.ndarray, longest: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(first window, end) of the runs of valid windows with one minimiser, none with more than ``longest`` windows."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(new)
    s, e = edge[:-1], edge[1:]
    own = valid[s]
    s, e = s[own], e[own]
    if len(s) and (e - s).max() > longest:
        parts = -(-(e - s) // longest)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        s, e = np.repeat(s, parts) + step * longest, np.minimum(np.repeat(s, parts) + (step + 1) * longest, np.repeat(e, parts))
    return s, e


@dataclass
class Runs:
    """Runs of one bucket: for each its minimiser (low bits), document (id and 32-bit text hash, which tells rows with one id apart), first place, number of windows, flag
    and packed string."""

    key: np.ndarray
    doc: np.ndarray
    text_hash: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    flag: np.ndarray
    packed: list[bytes]


def pack(rows: list[tuple]) -> bytes:
    """rows: (key, doc, text_hash, place, windows, flag, packed)."""
    key, doc, text_hash, place, windows, flag, packed = zip(*rows, strict=True)
    cols = [np.array(key, np.uint32), np.array(doc, np.int64), np.array(text_hash, np.int32), np.array(place, np.int64),
            np.array(windows, np.int32), np.array(flag, np.uint8), np.fromiter(map(len, packed), np.int32, len(packed))]
    # bytes of equal weight side by side compress better
    head = b"".join(c.view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in cols)
    return len(rows).to_bytes(8, "little") + zstandard.compress(head + b"".join(packed), 3)


def unpack(payloads: list[bytes]) -> Runs:
    kinds = [np.uint32, np.int64, np.int32, np.int64, np.int32, np.uint8, np.int32]
    cols: list[list[np.ndarray]] = [[] for _ in kinds]
    packed: list[bytes] = []
    for p in payloads:
        n, raw, at = int.from_bytes(p[:8], "little"), zstandard.decompress(p[8:]), 0
        for kind, out in zip(kinds, cols, strict=True):
            width = np.dtype(kind).itemsize
            block = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            out.append(np.ascontiguousarray(block).view(kind).reshape(n))
            at += n * width
        ends = at + np.cumsum(cols[-1][-1], dtype=np.int64)
        packed += [raw[s:e] for s, e in zip((ends - cols[-1][-1]).tolist(), ends.tolist(), strict=True)]
    joined = [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, kinds, strict=True)]
    return Runs(*joined[:6], packed)


@dataclass
class Outbox:
    """A mapper's runs by bucket; equal strings are kept once as ``merge`` says."""

    buckets: int
    size: int = 0
    rows: dict[int, list] = field(default_factory=dict)

    def add(self, key: int, row: tuple) -> None:
        self.rows.setdefault(key % self.buckets, []).append(row)
        self.size += len(row[-1]) + 32

    def flush(self) -> Iterator[pa.RecordBatch]:
        for bucket, rows in self.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack(rows)], pa.binary())], names=["bucket", "payload"])
        self.rows, self.size = {}, 0


def bucket_count(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def by_bucket(blobs: DataFrame, handle: Callable[[Runs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring the blobs of a bucket together and call ``handle`` with its runs, one bucket at a time."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield from handle(unpack(held))
                    held = []
                at = bucket
                held.append(payload)
        if held:
            yield from handle(unpack(held))

    parts = max(1, bucket_count(blobs) // 2)
    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def common_grams(grams_of_chunk: DataFrame) -> np.ndarray:
    """Grams in COMMON_SHARE of all documents, sorted.  Input: gram (null: the chunk's number of documents) and n, sums per chunk
    of the grams that are in that share of the chunk's documents.  The result only steers how load is spread."""
    total = written(grams_of_chunk.groupBy("gram").agg(F.sum("n").alias("n")), "common_grams")
    docs = total.where("gram is null").select("n")
    out = total.where("gram is not null").where(F.col("n") >= F.lit(COMMON_SHARE) * docs.scalar()).select("gram").toPandas()
    return np.sort(out["gram"].to_numpy(np.int64).view(np.uint64))


def chunk_grams(hashes: np.ndarray, owner: np.ndarray, docs: int) -> pa.RecordBatch:
    """Rows for common_grams of one chunk: grams in at least COMMON_SHARE (and 4) of its documents."""
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    grams, n = np.unique(h[new], return_counts=True)
    often = n >= max(4, COMMON_SHARE * docs)
    return pa.RecordBatch.from_arrays(
        [pa.array([*grams[often].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[often].tolist(), docs], pa.int64())], names=["gram", "n"]
    )


RANGE = "doc_id long, text_hash int, first long, end long"


def ranges_batch(doc, text_hash, first, end) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((doc, text_hash, first, end), kinds, strict=True)], names=["doc_id", "text_hash", "first", "end"])


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``docs`` (with text_hash) and ``ranges``, the list of (first, end) of its text; null if it has none."""
    own = ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    return docs.join(own, ["doc_id", "text_hash"], "left")
