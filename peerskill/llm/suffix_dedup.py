"""Suffix-array dedup: remove each byte covered by a 400-byte string that also starts anywhere else.

Suffixes that agree on 400 bytes have the same minimiser, so their packed runs meet in one bucket (see ``superkmer``).  There a
deep-shallow sort orders them: multikey quicksort on 8-byte keys to a shallow depth, for all suffixes of the bucket at once, then a
blind trie for each group that still agrees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superkmer as S
from .common import small_batches, texts
from .text import chunks, mix

#: Bytes of a match, of the grams that minimisers are taken from, and of the depth that quicksort goes to.
LENGTH, GRAM, SHALLOW = 400, 16, 16
#: Longer texts are read in pieces of this size, which overlap by a match less one byte.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = np.uint64(1) << np.uint64(63)


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at each place, by doubling."""
    h, base, span = buf.astype(np.uint64), _BASE, 1
    while span < GRAM:
        h = h[:-span] * np.uint64(base) + h[span:] if len(h) > span else h[:0]
        base = base * base % (1 << 64)
        span *= 2
    return mix(h)


def _pieces(batches, length: int):
    """(ids, text hashes, places in the text, buffer, starts and ends of the pieces in the buffer) of a chunk."""
    for rows, own in chunks(batches):
        ids, hashes, at, parts = [], [], [], []
        for d, h, t in zip(rows.column("doc_id").to_pylist(), rows.column("text_hash").to_pylist(), own, strict=True):
            for p in range(0, max(1, len(t) - length + 1), PIECE - length + 1):
                ids.append(d), hashes.append(h), at.append(p), parts.append(t[p : p + PIECE])
                if sum(map(len, parts)) > 2 * PIECE:
                    yield ids, hashes, at, parts
                    ids, hashes, at, parts = [], [], [], []
        if parts:
            yield ids, hashes, at, parts


def _anchored(parts: list[bytes], length: int):
    """Buffer of the pieces, hash of the gram at each place, mask of the grams that lie in a piece and are anchors (a sixteenth, by
    hash), owner of each place."""
    data = b"".join(parts)
    buf = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    gram = _gram_hashes(buf)
    owner = np.repeat(np.arange(len(parts)), sizes)
    inside = owner[: len(gram)] == owner[GRAM - 1 : GRAM - 1 + len(gram)]
    return data, sizes, gram, inside, (gram & np.uint64(15)) == 0, owner


def _common(docs: DataFrame, length: int) -> np.ndarray:
    def run(batches):
        for _, _, at, parts in _pieces(batches, length):
            if sum(map(len, parts)) >= length:
                _, _, gram, inside, anchor, owner = _anchored(parts, length)
                own = np.flatnonzero(inside & anchor)
                yield S.chunk_grams(gram[own], owner[own], sum(p == 0 for p in at))

    return S.common_grams(docs.mapInArrow(run, "gram long, n long"))


def _blobs(docs: DataFrame, length: int, common: np.ndarray) -> DataFrame:
    """Flags: 0 once in this task, 1 also with equal grams nearby (may repeat in itself), 2 a range that goes, 3 twice or more."""
    buckets = S.bucket_count(docs)
    w = length - GRAM + 1

    def run(batches):
        out, seen, again, size = S.Outbox(buckets), {}, [], 0

        def rows():
            nonlocal seen, again, size
            for row in seen.values():
                out.add(row[0], row)
            for row in again:  # equal to another run of this task: all its windows go
                out.add(row[1], (0, row[1], row[2], row[3], row[4], 2, b""))
            yield from out.flush()
            seen, again, size = {}, [], 0

        for ids, hashes, at, parts in _pieces(batches, length):
            if max(map(len, parts)) < length:
                continue
            data, sizes, gram, inside, anchor, owner = _anchored(parts, length)
            rank = S.ranks(gram, common) >> np.uint64(1)
            rank = np.where(anchor, rank, rank | _LAST)  # a window without an anchor takes its least gram
            least = S.window_min(rank, w)
            n = len(least)
            valid = owner[:n] == owner[length - 1 : length - 1 + n]
            begin, end = S.runs(least, valid)
            value = least[begin]
            ordered = np.sort(rank[inside & anchor])
            equal = np.searchsorted(ordered, value, "right") - np.searchsorted(ordered, value, "left")
            flag = (equal != 1).astype(np.uint8)
            first = np.concatenate(([0], np.cumsum(sizes)))
            doc = owner[begin]
            place = begin - first[doc] + np.array(at)[doc]
            key = mix(value).astype(np.uint32)
            for kk, d, p, nw, f, a in zip(key.tolist(), doc.tolist(), place.tolist(), (end - begin).tolist(), flag.tolist(), begin.tolist(), strict=True):
                s = data[a : a + nw + length - 1]
                row = (kk, ids[d], hashes[d], p, nw, f, s)
                had = seen.get(s)
                if had is None:
                    seen[s] = row
                    size += len(s) + 64
                else:
                    if had[5] != 3:
                        again.append(had)
                        seen[s] = (*had[:5], 3, s)
                    again.append(row)
                    size += 64
            if size > S.FLUSH_BYTES:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(run, S.BLOB)


class BlindTrie:
    """Suffixes of ``data`` by their first ``length`` bytes; inner nodes hold a depth and a child per byte there, and no strings."""

    def __init__(self, data: bytes, length: int):
        self.data, self.length, self.root, self.last = data, length, None, None

    def _common(self, p: int, q: int) -> int:
        d, lo, hi = self.data, 0, self.length
        if d[p : p + hi] == d[q : q + hi]:
            return hi
        while hi - lo > 1:  # the first lo bytes agree, the first hi do not
            mid = (lo + hi) // 2
            if d[p + lo : p + mid] == d[q + lo : q + mid]:
                lo = mid
            else:
                hi = mid
        return lo

    def add(self, p: int) -> None:
        d, last = self.data, self.last
        if last is None:
            self.root = self.last = [p]
            return
        if d[p : p + self.length] == d[last[0] : last[0] + self.length]:  # neighbours in a group are often equal
            last.append(p)
            return
        node = self.root
        while type(node) is tuple:
            child = node[1].get(d[p + node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        depth = self._common(p, node[0])
        if depth == self.length:
            node.append(p)
            self.last = node
            return
        self.last = [p]
        parent, byte, at = None, None, self.root
        while type(at) is tuple and at[0] < depth:
            parent, byte = at, d[p + at[0]]
            at = at[1][byte]
        if type(at) is tuple and at[0] == depth:
            at[1][d[p + depth]] = self.last
            return
        split = (depth, {d[node[0] + depth]: at, d[p + depth]: self.last})
        if parent is None:
            self.root = split
        else:
            parent[1][byte] = split

    def leaves(self):
        """Groups of equal suffixes, in order."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                yield node


def repeated(data: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Those of ``starts`` whose ``length`` bytes are also those of another start (deep-shallow sort)."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    # multikey quicksort: partition on 8 bytes at a time; groups of one are done
    at, group, depth = np.asarray(starts, np.int64), np.zeros(len(starts), np.int64), 0
    shallow = min(shallow, length // 8 * 8)
    while depth < shallow and len(at):
        key = np.zeros(len(at), np.uint64)
        for b in range(8):
            key = (key << np.uint64(8)) | padded[at + depth + b]
        order = np.lexsort((key, group)) if depth else np.argsort(key)
        at, group, key = at[order], group[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        single = new & np.append(new[1:], True)
        group = np.cumsum(new)
        at, group = at[~single], group[~single]
        depth += 8
    out: list[int] = []
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(at) else np.zeros(1, int)
    size = np.diff(edge)
    two = edge[:-1][size == 2]  # a trie of two leaves is one comparison
    for p, q in zip(at[two].tolist(), at[two + 1].tolist(), strict=True):
        if data[p : p + length] == data[q : q + length]:
            out += (p, q)
    at_list = at.tolist()
    for a, b in zip(edge[:-1][size > 2].tolist(), edge[1:][size > 2].tolist(), strict=True):
        trie = BlindTrie(data, length)
        for p in at_list[a:b]:
            trie.add(p)
        for leaf in trie.leaves():
            if len(leaf) > 1:
                out += leaf
    return np.sort(np.array(out, np.int64))


def _handler(length: int):
    def handle(r: S.Runs):
        gone = r.flag == 2
        parts = [(r.doc[gone], r.text_hash[gone], r.place[gone], r.place[gone] + r.windows[gone] + length - 1)]
        # equal strings of several tasks: one stays for sorting, the windows of all go
        kept: dict[bytes, int] = {}
        whole: set[int] = set()
        for i in np.flatnonzero(~gone).tolist():
            j = kept.setdefault(r.packed[i], i)
            if j != i:
                whole |= {i, j}
        live = np.array(list(kept.values()), np.int64)
        key = r.key[live]
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        alone = np.ones(len(live), bool)
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        live = live[~alone | (r.flag[live] == 1)]
        if len(live):
            data = b"".join(r.packed[i] for i in live.tolist())
            sizes = np.fromiter((len(r.packed[i]) for i in live.tolist()), np.int64, len(live))
            base = np.cumsum(sizes) - sizes
            n = r.windows[live].astype(np.int64)
            starts = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hit = repeated(data, starts, length)
            if len(hit):
                owner = np.searchsorted(base, hit, "right") - 1
                new = np.ones(len(hit), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(hit)) - 1
                i = live[owner[first]]
                parts.append((r.doc[i], r.text_hash[i], r.place[i] + hit[first] - base[owner[first]], r.place[i] + hit[last] - base[owner[first]] + length))
        whole |= set(np.flatnonzero(r.flag == 3).tolist())
        if whole:
            i = np.array(sorted(whole), np.int64)
            parts.append((r.doc[i], r.text_hash[i], r.place[i], r.place[i] + r.windows[i] + length - 1))
        yield S.ranges_batch(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    return handle


def _kept(cells: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for rows, own in chunks(batches):
            size, removed, spans, kept = [], [], [], []
            for t, ranges in zip(own, rows.column("ranges").to_pylist(), strict=True):
                out, at, n, gone = [], 0, 0, 0
                for a, b in sorted((x["first"], x["end"]) for x in ranges or ()):
                    if a > at or not n:
                        out.append(t[at:a])
                        n, gone, at = n + 1, gone + b - a, b
                    elif b > at:
                        gone, at = gone + b - at, b
                out.append(t[at:])
                size.append(len(t)), removed.append(gone), spans.append(n), kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(kept, pa.binary())], schema=schema)

    return cells.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of ``docs``.

    A byte goes if a string of ``length`` bytes (at least 32) that covers it also starts anywhere else in the table, the same document
    included; strings are judged on the input and never cross documents.  Texts shorter than ``length``, empty and null texts lose
    nothing.  Repeated rows are occurrences like any other, so the long ones go whole; so do rows with a null doc_id.

    One shuffle of packed runs (compressed by the mapper, equal runs of a task once), one of the hits, one of the texts."""
    small_batches(docs.sparkSession, 256)
    none = F.lit(-(1 << 63)).cast("long")  # stands for a missing id
    own = texts(docs).withColumn("text_hash", F.hash("text")).withColumn("doc_id", F.coalesce("doc_id", none))
    common = _common(own, length)
    ranges = S.by_bucket(_blobs(own, length, common), _handler(length), S.RANGE)
    return _kept(S.with_ranges(own, ranges)).withColumn("doc_id", F.when(F.col("doc_id") != none, F.col("doc_id")))
