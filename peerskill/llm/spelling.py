"""Spelling variant grouping by permuterm rotations.

A word w of L code points, marked as w$, has L + 1 rotations.  Two words of equal length that differ in one code point have rotations that
end in it and agree before it; a word that lacks one code point of another has a rotation that is the other's without its last code point.
So each word enters, for every rotation, the range of that rotation (as it is) and, for every rotation that ends in a letter, the range of
its prefix that skips the letter.  A range holds at most one word as it is and one word a letter of the alphabet, so that no range is
large; it is scanned for each member's count of neighbours and its best one, and pairs are never listed."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .text import chunks

#: Runs of letters after lower-casing A-Z; a run is made a misspelling where the hash of (doc_id, run) is a multiple of ``EVERY``.
RUN, EVERY = re.compile("[a-zÀ-ÿ]+"), 199
#: Least code points and occurrences of a word; a form has ``RATIO`` times the word's occurrences.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
_END = "$"
#: Distinct words that a task counts before it passes them on.
_HELD = 1 << 18


def run_counts(batches):
    """(word, n) sums of the runs of the batches (doc_id, text); the same word may come again."""
    found: Counter[str] = Counter()

    def out():
        table = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return table

    for rows, texts in chunks(batches):
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts, strict=True):
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for run, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes.lower() is A-Z only
                h = zlib.crc32(run.encode(), start)
                if h % EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                if len(run) >= LEAST_CHARS:
                    found[run] += n
        if len(found) >= _HELD:
            yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words of whole texts with at least ``LEAST_CHARS`` code points and ``LEAST_COUNT`` occurrences."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(run_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def ranges(words: DataFrame) -> DataFrame:
    """A row per range with more than one member: whole (of at most one word as it is), skipped (of the words with a letter skipped); both
    as (m = -n, word[, alone]) in order.  ``alone``: the letter before the skipped one differs, so that a word meets a shorter one once."""
    w, size = F.col("word"), F.char_length("word")
    char = lambda i: F.substr(w, i + 1, F.lit(1))
    as_is = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.concat(F.substr(w, i + 1), F.lit(_END), F.substr(w, F.lit(1), i)).alias("key"), F.lit(False).alias("skip"), F.lit(False).alias("alone")
    ))
    without = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.concat(F.substr(w, i + 2), F.lit(_END), F.substr(w, F.lit(1), i)).alias("key"), F.lit(True).alias("skip"), ((i == 0) | (char(i) != char(i - 1))).alias("alone")
    ))
    each = words.select("word", (-F.col("n")).alias("m"), F.explode(F.concat(as_is, without)).alias("r"))
    groups = each.groupBy("r.key").agg(F.collect_list(F.struct("m", "word", "r.skip", "r.alone")).alias("g")).where(F.size("g") > 1)
    return groups.select(
        F.transform(F.filter("g", lambda x: ~x["skip"]), lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"))).alias("whole"),
        F.array_sort(F.transform(F.filter("g", lambda x: x["skip"]), lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"), x["alone"].alias("alone")))).alias("skipped"),
    )


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near and best (m = -n, word) of the words of ``words`` (word, n; each once) that have a near word."""
    bare = lambda x: F.struct(x["m"].alias("m"), x["word"].alias("word"))
    whole, skipped = F.col("whole"), F.col("skipped")
    longer = F.filter(skipped, lambda x: x["alone"])

    def of_skipped(x: Column) -> Column:
        shorter = F.when(x["alone"], whole).otherwise(F.slice(whole, 1, 0))
        others = F.transform(F.slice(F.filter(F.slice(skipped, 1, 2), lambda y: y["word"] != x["word"]), 1, 1), bare)
        return F.struct(x["word"].alias("word"), (F.size(skipped) - 1 + F.size(shorter)).alias("n"), F.array_min(F.concat(others, shorter)).alias("best"))

    of_whole = F.transform(whole, lambda x: F.struct(x["word"].alias("word"), F.size(longer).alias("n"), F.array_min(F.transform(longer, bare)).alias("best")))
    each = ranges(words).select(F.explode(F.concat(F.transform(skipped, of_skipped), of_whole)).alias("x")).where("x.n > 0")
    return each.groupBy("x.word").agg(F.sum("x.n").alias("n_near"), F.min("x.best").alias("best"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of the rows (word, form) with a form.  A form has ``RATIO`` times the occurrences, so a chain is at most
    log(most / LEAST_COUNT) / log(RATIO) links long, and doubling its steps needs the logarithm of that in rounds."""
    links = max(1.0, math.log(max(most, LEAST_COUNT) / LEAST_COUNT, RATIO))
    at = written(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    for _ in range(math.ceil(math.log2(links + 1)) if links > 1 else 0):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        at = written(at.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "spelling_roots")
    return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of ``docs``.

    Null and empty texts have no words; a null doc_id hashes as an empty one.  Very long texts are read whole.  Repeated rows count each.
    Among near words of equal n the smallest in code-point order is the form.  Words without near word have n_near 0 and are their own
    root.  An empty table gives no row; other columns are ignored."""
    words = written(vocabulary(docs), "spelling_words")
    near = neighbours(words)
    far = F.when(-F.col("best.m") >= RATIO * F.col("n"), F.col("best"))
    joined = words.join(near, "word", "left").withColumn("f", far)
    linked = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.word").alias("form"), (-F.col("f.m")).alias("form_n")
    ), "spelling_linked")
    most = linked.agg(F.max("form_n")).first()[0] or 0
    root = roots(linked.where("form is not null"), most)
    return linked.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
