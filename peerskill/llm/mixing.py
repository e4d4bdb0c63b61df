"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling of documents.

Tokens are summed by cell (source, language, topic).  Raking scales the cells until the weighted tokens of every source, language
and topic match their targets; a document is then drawn with the probability of its cell."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = ("source", "lang", "topic")
#: Cells that are raked on the driver; more are raked by Spark, with the same result.
DRIVER_CELLS = 100_000
ROUNDS, TOLERANCE = 200, 1e-9
#: Most share of the weighted tokens that may be missed because a document is drawn once at most.
MISSED = 0.01


@dataclass(frozen=True)
class Mixture:
    """Targets of each dimension: shares by label (labels without one share the rest in proportion to their tokens), or, where none are
    given, shares in proportion to tokens ** temper."""

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: dict[str, float] = field(default_factory=dict)


def topic_of(text: Column) -> Column:
    """Default topic: the form of a text, from counts of characters (a rule, so that it needs no model): empty, table, symbols, shouted,
    listing, or prose by length."""
    n = F.char_length(text)

    def share(chars: str) -> Column:
        return (n - F.char_length(F.translate(text, chars, ""))) / n

    return (
        F.when(n == 0, "empty").when(share("|") > 0.04, "table").when(share("#*$%&<>") > 0.02, "symbols")
        .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "shouted").when(share("\n") > 0.05, "listing")
        .when(n < 1000, "short prose").when(n < 4000, "prose").otherwise("long prose")
    )


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def drawn() -> Column:
    """A uniform number in [0, 1) from doc_id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mixing"), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), 11).cast("double") / F.lit(float(1 << 53))


def measured(docs: DataFrame, topic=topic_of) -> DataFrame:
    """doc_id, DIMENSIONS (null: '(none)'), n_tokens and a uniform number in [0, 1) drawn from doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    label = {d: F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d) for d in ("source", "lang")}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), label["source"], label["lang"], topic(text).alias("topic"), token_count(text).alias("n_tokens"), drawn().alias("draw"))


def targets(totals: dict[str, float], shares: dict[str, float] | None, temper: float) -> dict[str, float]:
    """Share of each label, adding up to 1; labels without tokens have none."""
    live = {k: v for k, v in totals.items() if v > 0}
    if not live:
        return {}
    if shares is None:
        raw = {k: v**temper for k, v in live.items()}
    else:
        named = {k: shares[k] for k in live if shares.get(k, 0) > 0}
        rest = sum(v for k, v in live.items() if k not in shares)
        left = max(0.0, 1 - sum(named.values())) if rest else 0.0
        raw = named | {k: left * v / rest for k, v in live.items() if k not in shares and left}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def rake(cells: pd.DataFrame, mixture: Mixture) -> np.ndarray:
    """Weight of each cell (DIMENSIONS, n_tokens); cells without tokens or with a target of 0 have weight 0."""
    tokens = cells["n_tokens"].to_numpy(float)
    total, weight, goals = tokens.sum(), np.where(tokens > 0, 1.0, 0.0), []
    for d in DIMENSIONS:
        codes, labels = pd.factorize(cells[d])
        sums = dict(zip(labels, np.bincount(codes, tokens, len(labels)), strict=True))
        goal = targets(sums, mixture.shares.get(d), mixture.temper.get(d, 1.0))
        goals.append((codes, np.array([goal.get(x, 0.0) for x in labels]) * total))
    for _ in range(ROUNDS):
        worst = 0.0
        for codes, goal in goals:
            now = np.bincount(codes, tokens * weight, len(goal))
            factor = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            worst = max(worst, float(np.abs(now - goal).max(initial=0.0)))
            weight = weight * factor[codes]
        if worst <= TOLERANCE * max(total, 1.0):
            break
    return weight


def _rake_frame(cells: DataFrame, mixture: Mixture) -> DataFrame:
    """``rake`` for more cells than the driver should hold: cells and marginals stay tables."""
    now = written(cells.withColumn("weight", F.when(F.col("n_tokens") > 0, 1.0).otherwise(0.0)), "rake_cells")
    total = float(now.agg(F.sum("n_tokens")).first()[0] or 0)
    goals = {}
    for d in DIMENSIONS:
        own = now.groupBy(d).agg(F.sum("n_tokens").alias("t")).where("t > 0")
        shares = mixture.shares.get(d)
        if shares is None:
            own = own.withColumn("raw", F.pow("t", F.lit(float(mixture.temper.get(d, 1.0)))))
        else:
            named = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col(d)] if shares else F.lit(None).cast("double")
            own = written(own.withColumn("named", named), "rake_named")
            put, rest = own.agg(F.sum("named"), F.sum(F.when(F.col("named").isNull(), F.col("t")))).first()
            left = max(0.0, 1 - (put or 0.0)) if rest else 0.0
            own = own.withColumn("raw", F.coalesce("named", F.lit(left) * F.col("t") / F.lit(float(rest or 1))))
        own = written(own, "rake_raw")
        norm = own.agg(F.sum("raw")).first()[0] or 1.0
        goals[d] = written(own.select(d, (F.col("raw") / F.lit(float(norm)) * F.lit(total)).alias("goal")), "rake_goals")
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("now"))
            both = written(sums.join(goals[d], d, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0))), "rake_sums")
            worst = max(worst, both.agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0)
            factor = both.select(d, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            now = written(now.join(factor, d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"), "rake_cells")
        if worst <= TOLERANCE * max(total, 1.0):
            break
    return now


def _scale(missed, total: float, top: float) -> float:
    """The least weight (to a part in 2^40 of ``top``) for probability 1 at which ``missed``, the weighted tokens over it, is at most
    MISSED of ``total``: no few cells of extreme weight lower the chance of all others."""
    low, high = 0.0, top
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if missed(mid) > MISSED * total else (low, mid)
    return high or 1.0


def cell_weights(cells: DataFrame, mixture: Mixture, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """DIMENSIONS, weight and probability of each cell.  A probability is the weight over a scale, at most 1, so that expected tokens keep
    the targets but for MISSED of them (``_scale``); cells without tokens have probability 1."""
    spark = cells.sparkSession
    cells = written(cells, "mixing_cells")
    if cells.count() <= driver_cells:
        own = cells.toPandas()
        own["weight"] = rake(own, mixture)
        tokens, weight = own["n_tokens"].to_numpy(float), own["weight"].to_numpy(float)
        scale = _scale(lambda s: float((tokens * np.maximum(weight - s, 0)).sum()), float((tokens * weight).sum()), float(weight.max(initial=0.0)))
        own["probability"] = np.where(tokens > 0, np.minimum(weight / scale, 1.0), 1.0)
        return F.broadcast(spark.createDataFrame(own[[*DIMENSIONS, "weight", "probability"]], "source string, lang string, topic string, weight double, probability double"))
    weights = _rake_frame(cells, mixture)
    total, top = (float(x or 0) for x in weights.agg(F.sum(F.col("n_tokens") * F.col("weight")), F.max("weight")).first())
    scale = _scale(lambda s: float(weights.agg(F.sum(F.col("n_tokens") * F.greatest(F.col("weight") - F.lit(s), F.lit(0.0)))).first()[0] or 0), total, top)
    return weights.select(*DIMENSIONS, "weight", F.when(F.col("n_tokens") > 0, F.least(F.col("weight") / F.lit(scale), F.lit(1.0))).otherwise(1.0).alias("probability"))


def calibrated(stats: DataFrame, mixture: Mixture, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Adds weight, probability (1 for a document without tokens) and sampled to ``measured`` documents."""
    weights = cell_weights(stats.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")), mixture, driver_cells)
    chance = F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("probability"))
    return stats.join(weights, [*DIMENSIONS]).withColumn("probability", chance).withColumn("sampled", F.col("draw") < F.col("probability"))


#: Mixture of the registered query: sources, languages and topics are evened out in part.
FLATTENED = Mixture(temper={"source": 0.7, "lang": 0.7, "topic": 0.8})


def mix(docs: DataFrame, mixture: Mixture = FLATTENED, topic=topic_of) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and sampled of every row of ``docs``.

    Null sources and languages are a label of their own, '(none)'.  Null and empty texts have no tokens, do not count for the targets and
    are always sampled.  Equal rows are drawn alike; the draw depends on nothing but doc_id and text.  An empty table gives no rows."""
    stats = written(measured(docs, topic), "mixing_stats")
    return calibrated(stats, mixture).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")


#: Mixture of the pipeline: close to the documents' own shares, so that most of them stay.
GENTLE = Mixture(temper={"source": 0.95, "lang": 0.97})


def sampled_documents(docs: DataFrame, mixture: Mixture = GENTLE, topic=topic_of) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.  Texts are read twice and not shuffled."""
    stats = measured(docs, topic)
    weights = cell_weights(stats.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")), mixture)
    weights = weights.select(*(F.col(c).alias(f"_mix_{c}") for c in (*DIMENSIONS, "probability")))
    text = F.coalesce(F.col("text"), F.lit(""))
    label = {d: F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in ("source", "lang")} | {"topic": topic(text)}
    same = None
    for d in DIMENSIONS:
        same = (F.col(f"_mix_{d}") == label[d]) if same is None else same & (F.col(f"_mix_{d}") == label[d])
    return docs.join(weights, same).where((drawn() < F.col("_mix_probability")) | (token_count(text) == 0)).select(*(docs[c] for c in docs.columns))
