"""Substring dedup by super-k-mers of words: remove each word covered by a window whose words also start in an earlier document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import superkmer as S
from .common import small_batches, texts
from .text import Words, chunks, covered, window_hashes

#: Words of a window, of its m-grams.
WINDOW, GRAM = 13, 3


def _chunks(batches, piece_words: int):
    """(doc ids, text hashes, Words of the texts)."""
    for rows, own in chunks(batches):
        yield rows.column("doc_id").to_pylist(), rows.column("text_hash").to_pylist(), Words(own)


def _grams(w: Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    owner = w.text_of_word
    h = window_hashes(w.hashes(), m)
    return h, owner[: len(h)]


def _common(docs: DataFrame, k: int, m: int) -> np.ndarray:
    def run(batches):
        for ids, _, w in _chunks(batches, k):
            h, owner = _grams(w, m)
            yield S.chunk_grams(h, owner, len(ids))

    return S.common_grams(docs.mapInArrow(run, "gram long, n long"))


def _packed_words(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and the start and end of each."""
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    keep = ~w.is_space
    keep[w.ends] = True  # one separator after each word
    joined = w.buf[keep]
    joined = np.where(w.is_space[keep], np.uint8(32), joined)
    return joined.tobytes(), ends - size, ends


def _blobs(docs: DataFrame, k: int, m: int, common: np.ndarray) -> DataFrame:
    buckets = S.bucket_count(docs)

    def run(batches):
        out = S.Outbox(buckets)
        seen: dict[bytes, tuple] = {}  # string -> rows of the smallest document that has it
        later: list[tuple] = []  # runs whose string an earlier document of this task has

        def rows():
            nonlocal seen, later
            for own in seen.values():
                for row in own:
                    out.add(row[0], row)
            yield from out.flush()
            if later:  # removed whatever the others hold: pass them on as ranges
                doc, text_hash, first, windows = zip(*later, strict=True)
                row = [(0, d, t, f, n, 2, b"") for d, t, f, n in zip(doc, text_hash, first, windows, strict=True)]
                for i in range(0, len(row), 4096):
                    out.add(row[i][1], row[i])
                    out.rows[row[i][1] % buckets] += row[i + 1 : i + 4096]
                yield from out.flush()
            seen, later = {}, []

        size = 0
        for ids, hashes, w in _chunks(batches, k):
            if int(w.first[-1]) < k:
                continue
            gram, _ = _grams(w, m)
            least = S.window_min(S.ranks(gram, common), k - m + 1)
            n = len(least)
            owner = w.text_of_word
            valid = owner[:n] == owner[k - 1 : k - 1 + n]
            begin, end = S.runs(least, valid)
            data, ws, we = _packed_words(w)
            doc = owner[begin]
            place = begin - w.first[doc]
            key = (least[begin] ^ (least[begin] >> np.uint64(32))).astype(np.uint32)
            for kk, d, p, nw, a, b in zip(key.tolist(), doc.tolist(), place.tolist(), (end - begin).tolist(), ws[begin].tolist(), we[end + k - 2].tolist(), strict=True):
                if ids[d] is None:
                    continue
                s = data[a:b]
                size += len(s) + 32
                row = (kk, ids[d], hashes[d], p, nw, 0, s)
                had = seen.get(s)
                if had is None:
                    seen[s] = (row,)
                elif had[0][1] == row[1]:
                    seen[s] = (*had, row)
                elif had[0][1] < row[1]:
                    later.append((row[1], row[2], p, nw))
                else:
                    later += [(x[1], x[2], x[3], x[4]) for x in had]
                    seen[s] = (row,)
            if size > S.FLUSH_BYTES:
                yield from rows()
                size = 0
        yield from rows()

    return docs.mapInArrow(run, S.BLOB)


def _windows(packed: bytes, n: int, k: int) -> list[bytes]:
    """The ``n`` windows of ``k`` words of a packed string."""
    at = [0]
    i = packed.find(b" ")
    while i >= 0:
        at.append(i + 1)
        i = packed.find(b" ", i + 1)
    at.append(len(packed) + 1)
    return [packed[at[j] : at[j + k] - 1] for j in range(n)]


def _handler(k: int):
    def handle(r: S.Runs):
        done = r.flag == 2
        parts = [(r.doc[done], r.text_hash[done], r.place[done], r.place[done] + r.windows[done] + k - 1)]
        live = np.flatnonzero(~done)
        order = live[np.lexsort((r.doc[live], r.key[live]))]
        key, doc = r.key[order], r.doc[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(order) else np.zeros(1, int)
        many = doc[edge[:-1]] != doc[edge[1:] - 1] if len(order) else np.zeros(0, bool)  # of two documents at least
        hit: list[tuple[int, int, int]] = []
        for a, b in zip(edge[:-1][many].tolist(), edge[1:][many].tolist(), strict=True):
            own = order[a:b]  # by document
            items = [(x, i, j) for i in own.tolist() for j, x in enumerate(_windows(r.packed[i], int(r.windows[i]), k))]
            at = sorted(range(len(items)), key=lambda t: items[t][0])  # stable: by window, then by document
            last, least = None, 0
            for t in at:
                x, i, j = items[t]
                if x != last:
                    last, least = x, r.doc[i]
                elif r.doc[i] > least:
                    hit.append((i, j, j + k))
        if hit:
            i, a, b = (np.array(c) for c in zip(*hit, strict=True))
            by = np.lexsort((a, i))
            i, a, b = i[by], a[by], b[by]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (a[1:] > b[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(i)) - 1
            i, a, b = i[first], a[first], b[last]
            parts.append((r.doc[i], r.text_hash[i], r.place[i] + a, r.place[i] + b))
        yield S.ranges_batch(*(np.concatenate(c) for c in zip(*parts, strict=True)))

    return handle


def _kept(cells: DataFrame, carry: list[str], unchanged: bool) -> DataFrame:
    names = ["doc_id", "n_words", "n_removed", "kept_text", *carry]

    def run(batches):
        for rows, own in chunks(batches):
            w = Words(own)
            removed, kept = [], []
            for i, ranges in enumerate(rows.column("ranges").to_pylist()):
                words = w.words(i)
                if ranges:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [x["first"] for x in ranges], 1)
                    np.add.at(gone, [x["end"] for x in ranges], -1)
                    gone = np.cumsum(gone[:-1]) > 0
                    words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(int(w.counts[i]) - len(words))
                kept.append(own[i] if unchanged and not removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *map(rows.column, carry)],
                names=names,
            )

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in cells.select(*carry).schema) if carry else ""
    return cells.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string" + more)


def substring_dedup(docs: DataFrame, k: int = WINDOW, m: int = GRAM, carry: tuple[str, ...] = (), unchanged: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every row of ``docs``, and its columns ``carry``.
    With ``unchanged`` a text that loses nothing stays as it is, spaces included.

    A word goes if a window of ``k`` words that covers it also starts in a document with a smaller doc_id; windows are judged on the
    input.  Texts with fewer than ``k`` words, empty and null texts lose nothing.  A null doc_id has no order: such rows lose
    nothing and make others lose nothing.  Rows with equal doc_id never make each other lose words.

    One shuffle of packed runs by minimiser (compressed by the mapper, equal runs of a task once), one of the hits, one of the texts by
    doc_id.  A bucket is handled by one task, in memory; hot passages are spread as ``superkmer`` says."""
    small_batches(docs.sparkSession, 256)
    own = texts(docs).withColumn("text_hash", F.hash("text"))
    common = _common(own, k, m)
    ranges = S.by_bucket(_blobs(own, k, m, common), _handler(k), S.RANGE)
    whole = texts(docs, *(F.col(c).alias(f"_carry_{c}") for c in carry)).withColumn("text_hash", F.hash("text"))
    out = _kept(S.with_ranges(whole, ranges), [f"_carry_{c}" for c in carry], unchanged)
    return out.withColumnsRenamed({f"_carry_{c}": c for c in carry})
