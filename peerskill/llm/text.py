"""Vectorised word index over the texts of an Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+``.  These separators are single bytes in UTF-8, so texts are split as bytes.
Everything is numpy over one chunk of whole texts at a time; a chunk holds about ``CHUNK_BYTES`` or a single longer text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_PIECE = 1 << 20  # bytes hashed at a time
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15 | 1


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """(rows, texts as bytes) of consecutive rows; a null text is empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        first = size = 0
        for i, t in enumerate(texts):
            if i > first and size + len(t) > limit:
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(t)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for ranges in ascending order, from prefix sums over pieces of the buffer."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    at = 0
    up = down = np.ones(1, np.uint64)
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, side="right")))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        if len(up) < hi - lo + 1:
            n = max(hi - lo + 1, min(_PIECE + 1, len(buf) + 1))
            up, down = _powers(_BASE, n), _powers(inverse, n)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.multiply(buf[lo:hi], up[: hi - lo], out=sums[1:], dtype=np.uint64, casting="unsafe")
        np.cumsum(sums, out=sums)
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        out[at:stop] = mix(((sums[e] - sums[s]) * down[s]) ^ ((e - s).astype(np.uint64) << np.uint64(48)))
        at = stop
    return out


class Words:
    """Word index of texts: ``starts``/``ends`` byte ranges in ``data``; text i has the words first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b"\n".join([b"", *texts, b""])
        self.data = data.lower() if lower else data  # bytes.lower() is A-Z only
        self.buf = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes + 1)))[: len(texts)] + 1
        self.text_end = self.text_start + sizes
        space = np.zeros(256, bool)
        space[list(_SPACES)] = True
        self.is_space = space[self.buf]
        edges = np.flatnonzero(self.is_space[1:] != self.is_space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.append(np.searchsorted(self.starts, self.text_start), len(self.starts))
        self.counts = np.diff(self.first)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.buf, self.starts, self.ends)

    def words(self, i: int) -> list[bytes]:
        return self.data[self.text_start[i] : self.text_end[i]].split()


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, by its first word (runs may cross texts; see ``inside``)."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashes[j : j + m]
    return mix(out)


def inside(first: np.ndarray, n: int) -> np.ndarray:
    """Mask over the runs of ``n`` words: true where the whole run lies in one text."""
    total = int(first[-1])
    m = max(0, total - n + 1)
    left = np.repeat(first[1:], np.diff(first))[:m] - np.arange(m)
    return left >= n


def covered(size: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``size`` places that a run of ``n`` places beginning at one of ``starts`` covers."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, size), -1)
    return np.cumsum(steps[:-1]) > 0
