"""Filter interaction audit: what each of a few filters removes, in every order, and its Shapley share, by Hart-Mas-Colell potentials.

Each document becomes a bit mask of the filters that it fails.  A coalition S of filters plays the removal game v(S) = documents that fail
any filter of S.  The potential is P(empty) = 0 and P(S) = (v(S) + sum of P(S without i) over i in S) / |S|, found recursively over all
coalitions; filter i's Shapley value is P(all) - P(all without i).  What a filter removes behind the coalition S is v(S with i) - v(S).

Only masks are counted, so a part of any size is one row per mask after the map-side sums, 2^filters rows at most."""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .fingerprint import words

FILTERS = "ABCDE"
#: Thresholds of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_UPPER_PCT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bits(conditions: list[Column]) -> Column:
    return reduce(Column.__add__, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part (source; null: empty) and mask (bit i: fails filter i of ``FILTERS``) of every row of ``docs``.

    Null texts are empty; an empty text fails A, and E if a smaller doc_id has one.  E looks at the whole table; a row without doc_id is
    neither smaller nor larger than any.  Repeated rows of one doc_id count each and do not fail E by each other.  Texts are equal if
    their SHA-256 is.  Only (digest, least doc_id) of the digests found twice is joined back; Spark splits a hot digest in that join."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("w", words(F.col("text")))
    t = t.withColumns({"n": F.size("w"), "n_distinct": F.size(F.array_distinct("w")), "n_chars": F.char_length("text")}).drop("w")
    upper = F.col("n_chars") - F.char_length(F.translate("text", _UPPER, ""))
    own = _bits([
        F.col("n") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT_PCT * F.col("n"),
        100 * upper.cast("long") > MOST_UPPER_PCT * F.col("n_chars"), F.col("text").rlike(SYMBOLS),
    ])
    rows = written(t.select("doc_id", "part", own.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit_rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = written(firsts, "audit_firsts")
    return rows.join(firsts, "digest", "left").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))).alias("mask")
    )


def removal_game(cells: str, value: str, filters: int) -> Column:
    """v(S) of all coalitions S (array index: bit mask) from ``cells``, an array of (mask, ``value``, ...)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit((1 << filters) - 1)),
        lambda s: F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) != 0, c[value]).otherwise(F.lit(0))),
    )


def potentials(game: Column, filters: int) -> Column:
    """Potentials of all coalitions times lcm(1..filters), which makes them whole numbers."""
    scale = math.lcm(*range(1, filters + 1))

    def next_one(found: Column, s: Column) -> Column:
        without = [F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.get(found, s.bitwiseXOR(F.lit(1 << i)))).otherwise(F.lit(0)) for i in range(filters)]
        return F.concat(found, F.array(F.call_function("div", reduce(Column.__add__, without, scale * F.get(game, s)), F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), F.array(F.lit(0).cast("long")), next_one)


def audit(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order and step of ``filters`` (one letter a bit of mask) for every part of ``masks`` (doc_id, part, mask).

    ``labels`` (doc_id, quality, toxic): a document is good (toxic) if any of its label rows has quality (toxic) 1; repeated or null ids
    and nulls there change nothing else.  An empty table gives no row.  n filters give n * n! rows a part, so n is meant to be small."""
    n, full = len(filters), (1 << len(filters)) - 1
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    each = masks.join(known, "doc_id", "left").groupBy("part", "mask")
    each = each.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = each.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # one cell a mask
    parts = parts.withColumns({c: removal_game("cells", c, n) for c in ("n", "good", "toxic")})
    parts = parts.withColumn("total", F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"])).drop("cells")
    parts = parts.withColumn("potential", potentials(F.col("n"), n))
    parts = parts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)])))
    steps = parts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    earlier, letter = F.expr("substr(filter_order, 1, step - 1)"), F.expr("substr(filter_order, step, 1)")
    steps = steps.withColumns({"bit": _bits([letter == x for x in filters]), "before": _bits([F.contains(earlier, F.lit(x)) for x in filters])})
    after, rest = F.col("before") + F.col("bit"), F.lit(full) - F.col("bit")
    gone = lambda c: F.get(c, after) - F.get(c, F.col("before"))
    last = lambda c: F.get(c, F.lit(full)) - F.get(c, rest)
    orders = math.factorial(n) // math.lcm(*range(1, n + 1))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.get("n", after)).alias("kept"), gone("n").alias("removed"),
        (F.get("n", F.col("bit")) - gone("n")).alias("redundant"), last("n").alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), (orders * last("potential")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters on whole texts; see ``failures`` for nulls, empty texts, repeats and equal texts.  Very long texts are
    counted whole; columns of any other name are ignored."""
    return audit(failures(docs), labels)
