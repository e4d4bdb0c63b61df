"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions.

Each round grows one conjunction of thresholds on part of the labelled statistics (FOIL gain), prunes it on the rest, keeps it
if it is precise there, removes what it covers and goes on.  The list says *reject*; a document that no rule covers is kept."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_rows, written
from .stats import FEATURES, counted, features

#: Most labelled rows that rules are learned from (those with the smallest hash of doc_id).
LEARN_ROWS = 20_000
MIN_WORDS, REPEAT_PERCENT = 10, 20


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, '>=' or '<', threshold) that rejects a document, with its precision on the pruning rows."""

    tests: tuple[tuple[str, str, float], ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, x in self.tests:
            out = out & ((F.col(name) >= F.lit(x)) if op == ">=" else (F.col(name) < F.lit(x)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {x:.6g}" for n, op, x in self.tests)


def _cover(x: np.ndarray, tests) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, t in tests:
        out &= (x[:, j] >= t) if op == ">=" else (x[:, j] < t)
    return out


def _grow(x, y, edges, most_tests: int):
    tests, inside = [], np.ones(len(x), bool)
    while len(tests) < most_tests and inside.any() and not y[inside].all():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base = np.log2(p0 / (p0 + n0)) if p0 else 0.0
        best = (0.0, None)
        for j in range(x.shape[1]):
            v, own = x[inside, j], y[inside]
            place = np.searchsorted(edges[j], v, side="right")  # v >= edges[k] iff place > k
            pos = np.bincount(place[own], minlength=len(edges[j]) + 1)
            neg = np.bincount(place[~own], minlength=len(edges[j]) + 1)
            over_p, over_n = p0 - np.cumsum(pos)[:-1], n0 - np.cumsum(neg)[:-1]
            for op, p, n in ((">=", over_p, over_n), ("<", p0 - over_p, n0 - over_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (gain.max(), (j, op, float(edges[j][int(gain.argmax())])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _cover(x, tests[-1:])
    return tests


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], *, least_precision: float = 0.9, least_cover: int = 8,
          most_rules: int = 24, most_tests: int = 4, cuts: int = 128) -> list[Rule]:
    """Sequential covering.  Rows alternate between growing (two of three) and pruning (one of three)."""
    x, bad = np.asarray(x, float), np.asarray(bad, bool)
    part = np.arange(len(x)) % 3 == 2
    gx, gy, px, py = x[~part], bad[~part], x[part], bad[part]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 1)[1:])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    rules: list[Rule] = []

    def worth(t) -> tuple[float, int]:
        c = _cover(px, t)
        p, n = int(py[c].sum()), int((~py[c]).sum())
        return (p - n) / max(1, p + n), p + n

    while gy.sum() >= least_cover and len(rules) < most_rules:
        tests = _grow(gx, gy, edges, most_tests)
        if not tests:
            break
        while len(tests) > 1 and worth(tests[:-1])[0] >= worth(tests)[0]:
            tests = tests[:-1]
        value, size = worth(tests)
        own = _cover(gx, tests)
        precision = (value + 1) / 2
        if size < max(2, least_cover // 3) or precision < least_precision or gy[own].mean() < least_precision:
            break
        rules.append(Rule(tuple((names[j], op, t) for j, op, t in tests), precision))
        gx, gy = gx[~own], gy[~own]
        rest = ~_cover(px, tests)
        px, py = px[rest], py[rest]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the document, or null: one ordered CASE expression."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(r.column(), F.lit(i + 1)) if out is None else out.when(r.column(), F.lit(i + 1))
    return out.cast("int") if out is not None else F.lit(None).cast("int")


def labelled(stats: DataFrame, labels: DataFrame, rows: int, seed: str) -> DataFrame:
    """FEATURES and ``good`` of the at most ``rows`` labelled documents with the smallest hash of doc_id.

    Of repeated label rows of a document the smallest quality counts; null ids and labels are left out."""
    own = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(rows)
    )
    return (
        features(stats).join(own, "doc_id").select("doc_id", *(F.col(c).cast("double") for c in FEATURES), (F.col("quality") == 1).alias("good"))
        .dropDuplicates(["doc_id"]).orderBy(F.xxhash64(F.lit(seed), "doc_id"))
    )


def learned(stats: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> list[Rule]:
    """Rules learned on a bounded sample of labelled rows (``rows``); bad is quality other than 1."""
    pdf = labelled(stats, labels, rows, "rules").toPandas()
    return learn(pdf[FEATURES].to_numpy(), ~pdf["good"].to_numpy(bool), FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, rule (the first that rejects, null if none) and kept."""
    return (
        features(stats).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule and kept of every document.

    Null and empty texts have no words and fail the base rule.  Repeated rows each get a row.  With no labels the list is empty and
    only the base rule rejects.  The statistics are written once (one pass over the texts) and read for learning and judging."""
    stats = written(counted(docs), "rule_stats")
    rules = learned(stats, labels)
    return judged(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept"
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    stats = written(counted(docs), "rule_stats")
    kept = judged(stats, learned(stats, labels)).where("kept")
    return only_rows(docs, written(kept.select("doc_id", "text_hash"), "rule_kept"))
