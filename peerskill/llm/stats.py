"""Document statistics: counts over whole texts, computed per Arrow batch, and the ratios that models read.

A null text is empty; an empty text has zero in every count.  Ratios of an empty text are 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .text import Words, chunks, covered, inside, mix, window_hashes

#: Counts of a text, all long.
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_digits", "n_marks", "n_bangs", "n_lines", "n_stops", "n_distinct_words", "n_twins", "n_short_words", "n_long_words",
]
_SYMBOLS = b"#*$%&|<>"
_MARKS = b".,;:!?'\"()-"
_SPACE = b" \t\n\x0b\x0c\r"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _distinct_per_text(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of distinct keys; and the mask of the keys that occur twice or more in their text."""
    tied = mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(tied, kind="stable")
    s = tied[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    twice = ~new
    twice[:-1] |= ~new[1:]
    mask = np.zeros(len(s), bool)
    mask[order] = twice
    return np.bincount(owner[order[new]], minlength=n), mask


def counts(batch_texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    w, n = Words(batch_texts), len(batch_texts)
    buf = w.buf
    owner = w.text_of_word

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[w.text_end] - c[w.text_start]

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n).astype(np.int64)

    h = w.hashes()
    begins = (buf & 0xC0) != 0x80  # first bytes of code points
    length = w.ends - w.starts
    runs = np.flatnonzero(inside(w.first, 5))
    repeat = np.zeros(len(h), bool)
    if len(runs):
        _, twice = _distinct_per_text(window_hashes(h, 5)[runs], owner[runs], n)
        repeat = covered(len(h), runs[twice], 5)
    twin = np.zeros(len(h), bool)
    twin[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    dup, lines = [], []
    for t in batch_texts:
        own = [x for x in t.split(b"\n") if x.strip(_SPACE)]
        lines.append(len(own))
        dup.append(len(own) - len(set(own)))
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": per_text(begins & ~w.is_space),
        "n_symbols": per_text(_table(_SYMBOLS)[buf]),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": per_word(repeat),
        "n_upper": per_text((buf >= 65) & (buf <= 90)),
        "n_digits": per_text((buf >= 48) & (buf <= 57)),
        "n_marks": per_text(_table(_MARKS)[buf]),
        "n_bangs": per_text(buf == 33),
        "n_lines": np.array(lines, np.int64),
        "n_stops": per_text(buf == 46),
        "n_distinct_words": _distinct_per_text(h, owner, n)[0].astype(np.int64),
        "n_twins": per_word(twin),
        "n_short_words": per_word(length <= 2),
        "n_long_words": per_word(length >= 16),
    }


#: Ratios that the models read, as (name, numerator, denominator), and the logarithm of the length.
RATIOS = [
    ("chars_per_word", "word_chars", "n_words"), ("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeats", "n_repeat_words", "n_words"), ("upper", "n_upper", "word_chars"), ("digits", "n_digits", "word_chars"),
    ("marks", "n_marks", "word_chars"), ("bangs", "n_bangs", "n_words"), ("words_per_line", "n_words", "n_lines"),
    ("words_per_stop", "n_words", "n_stops"), ("distinct", "n_distinct_words", "n_words"), ("twins", "n_twins", "n_words"),
    ("short_words", "n_short_words", "n_words"), ("long_words", "n_long_words", "n_words"),
]
FEATURES = ["n_words", *(r[0] for r in RATIOS)]


def features(counted: DataFrame) -> DataFrame:
    """Adds FEATURES (double); ``n_words`` stays as it is, the ratios are 0 where the denominator is 0."""
    return counted.withColumns(
        {name: F.when(F.col(d) > 0, F.col(a) / F.col(d)).otherwise(F.lit(0.0)) for name, a, d in RATIOS}
    )


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (which tells rows with one id apart) and COUNTS of every whole text; one narrow stage, no shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches):
        for rows, own in chunks(batches):
            got = counts(own)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_hash"), *(pa.array(got[c]) for c in COUNTS)], schema=schema)

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))
