"""Peer benchmark (E-2): every target's tag stats against the medians of its peers.

Inputs are whole tables: per-(user, item) rows, and ``peers(target_key,
peer_key, ...)`` for all targets at once.  A user's stats of the 20 tags are
one row with a fixed array (three whole numbers a tag), so peers meet them in
N x k rows, not N x k x 20; the k arrays of a target are gathered, and the
medians of a tag are read from its sorted slice of at most k values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TAGS
from ..functions import formulas as fx
from . import skill as S


def user_slots(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """A-1 (rated items only, P-13) -> A-5 as one row per user: total_solved and ``slots``, for each of the 20 tags in canonical order the
    solved and attempted items and the ratings solved, added up.  One shuffle on the user, with 60 conditional sums."""
    rated = pairs.filter(F.col("item_rating") > 0).select("user_key", "item", "item_rating", "ever_ac")
    t = S.with_tags(rated, items)
    tag = lambda x: F.array_contains("tags", x)
    solved = F.col("ever_ac") == 1
    cells = [F.coalesce(c, F.lit(0).cast("long")) for x in TAGS for c in (
        F.count_if(tag(x) & solved), F.count_if(tag(x)), F.sum(F.when(tag(x) & solved, F.col("item_rating").cast("long"))))]
    return t.groupBy("user_key").agg(F.sum("ever_ac").cast("long").alias("total_solved"), F.array(*cells).alias("slots"))


def slots_of(stats: DataFrame) -> DataFrame:
    """``user_slots`` of long stats (user_key, tag, solved, attempted, avg_difficulty, total_solved)."""
    cell = lambda x, c: F.coalesce(F.max(F.when(F.col("tag") == x, c)), F.lit(0)).cast("long")
    rated = F.round(F.col("avg_difficulty") * F.col("solved"))
    return stats.groupBy("user_key").agg(F.max("total_solved").alias("total_solved"), F.array(
        *[cell(x, c) for x in TAGS for c in (F.col("solved"), F.col("attempted"), rated)]).alias("slots"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value found once."""
    return F.transform(F.array(value), body)[0]


def median_of(values: Column) -> Column:
    """Median of an array: the middle of its sorted values, the mean of two for an even number; null for none."""
    def middle(s: Column) -> Column:
        n = F.size(s)
        half = F.floor(n / 2).cast("int")
        return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)

    return _let(F.array_sort(values), middle)


_MEDIANS = ["peer_median_solved", "peer_median_acceptance", "peer_median_difficulty", "peer_median_specialization"]


def slot_medians(peers: DataFrame, slots: DataFrame) -> DataFrame:
    """A-12: target_key and ``medians``, an array of 20 structs; 0 when no value.

    solved over all peers present in the stats (J-17); acceptance over peers
    with attempted > 0; difficulty over solved > 0; specialization over
    total_solved > 0."""
    side = slots.select(F.col("user_key").alias("peer_key"), F.struct("total_solved", "slots").alias("p"))
    own = peers.select("target_key", "peer_key").join(side, "peer_key", "left").groupBy("target_key").agg(F.collect_list("p").alias("ps"))  # k rows a target
    ps = F.col("ps")

    def of(i: Column) -> Column:
        at = lambda p, j: F.get(p["slots"], i * 3 + j)
        med = lambda keep, value: F.coalesce(median_of(F.transform(F.filter(ps, keep), value)), F.lit(0.0))
        return F.struct(
            F.coalesce(median_of(F.transform(ps, lambda p: at(p, 0).cast("double"))), F.lit(0.0)).alias(_MEDIANS[0]),
            med(lambda p: at(p, 1) > 0, lambda p: at(p, 0) / at(p, 1)).alias(_MEDIANS[1]),
            med(lambda p: at(p, 0) > 0, lambda p: at(p, 2) / at(p, 0)).alias(_MEDIANS[2]),
            med(lambda p: p["total_solved"] > 0, lambda p: at(p, 0) / p["total_solved"]).alias(_MEDIANS[3]),
        )

    return own.select("target_key", F.transform(F.sequence(F.lit(0), F.lit(len(TAGS) - 1)), of).alias("medians"))


def _by_tag(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row per entry of ``column``: ord, tag and the entry ``x``."""
    names = F.array(*[F.lit(t) for t in TAGS])
    return df.select(*keep, F.posexplode(column).alias("ord", "x")).withColumn("tag", F.get(names, F.col("ord")))


def peer_medians(peers: DataFrame, stats: DataFrame) -> DataFrame:
    """A-12 in long form, from long stats: per (target, tag) the medians over peers that have stats."""
    return _by_tag(slot_medians(peers, slots_of(stats)), "medians", "target_key").select("target_key", "tag", "x.*")


def peer_benchmark(pairs: DataFrame, items: DataFrame, peers: DataFrame) -> DataFrame:
    """E-2 for all targets in ``peers`` that have stats: F-9 / F-10 and L-3 for every (target, tag)."""
    slots = user_slots(pairs, items)
    own = slots.withColumnRenamed("user_key", "target_key").join(slot_medians(peers, slots), "target_key")
    each = F.transform(F.col("medians"), lambda m, i: F.struct(
        F.get("slots", i * 3).alias("solved"), F.get("slots", i * 3 + 1).alias("attempted"), F.get("slots", i * 3 + 2).alias("rated"), m.alias("m")))
    j = _by_tag(own.withColumn("each", each), "each", "target_key", "total_solved").select(
        "target_key", "tag", "ord", "total_solved", "x.solved", "x.attempted", "x.m.*",
        F.when(F.col("x.solved") > 0, F.col("x.rated") / F.col("x.solved")).otherwise(F.lit(0.0)).alias("avg_difficulty"))
    solved, attempted, total = F.col("solved"), F.col("attempted"), F.col("total_solved")
    user_acc = F.when(attempted > 0, solved / attempted).otherwise(F.lit(0.0))
    user_spec = F.when(total > 0, solved / total).otherwise(F.lit(0.0))
    acc = fx.ratio_score(user_acc, F.col("peer_median_acceptance"))
    diff = fx.difficulty_ratio(F.col("avg_difficulty"), solved, F.col("peer_median_difficulty"))
    spec = fx.ratio_score(user_spec, F.col("peer_median_specialization"))
    vol = fx.volume_ratio(solved, F.col("peer_median_solved"))
    out = j.select(
        "target_key", "tag", "ord", "solved", "attempted", "avg_difficulty",
        user_acc.alias("acceptance_rate"), user_spec.alias("specialization_score"),
        acc.alias("acc_score"), diff.alias("diff_score"), spec.alias("spec_score"), vol.alias("vol_score"),
        fx.peer_strength(acc, diff, spec, vol).alias("strength"), *_MEDIANS,
    )
    # L-3: rank tags with attempted >= 1 by strength desc, canonical tag order on ties; at most 20 rows a window
    w = Window.partitionBy("target_key", (F.col("attempted") >= 1)).orderBy(F.col("strength").desc(), "ord")
    return out.withColumn("tag_rank", F.when(F.col("attempted") >= 1, F.row_number().over(w)).cast("int")).drop("ord")


# A-13 / A-14 / F-11 variant ----------------------------------------------------

_STORED = ["acceptance_rate", "difficulty_score", "specialization_score", "ac_count", "tag_strength"]


def peer_medians_variant(peers: DataFrame, user_tag: DataFrame) -> DataFrame:
    """A-13: medians of the stored component scores and ac_count (A-14: of the strength), only peers that have the tag.

    A peer's scores are one row with 20 slots (null: a tag it has not), as in ``slot_medians``."""
    slot = lambda t: F.max(F.when(F.col("tag") == t, F.array(*[F.col(c).cast("double") for c in _STORED])))
    slots = user_tag.groupBy(F.col("user_key").alias("peer_key")).agg(F.array(*[slot(t) for t in TAGS]).alias("slots"))
    own = peers.select("target_key", "peer_key").join(slots, "peer_key").groupBy("target_key").agg(F.collect_list("slots").alias("ps"))

    def of(i: Column) -> Column:
        has = F.filter(F.transform("ps", lambda s: F.get(s, i)), lambda s: s.isNotNull())
        names = ["med_acceptance", "med_difficulty", "med_specialization", "med_ac_count", "med_strength"]
        score = lambda j: F.transform(has, lambda s: F.get(s, F.lit(j)))
        return F.struct(F.size(has).alias("n"), *[median_of(score(j)).alias(name) for j, name in enumerate(names)])

    each = own.select("target_key", F.transform(F.sequence(F.lit(0), F.lit(len(TAGS) - 1)), of).alias("medians"))
    return _by_tag(each, "medians", "target_key").where("x.n > 0").select("target_key", "tag", "x.*").drop("n")


def peer_strength_variant(user_tag: DataFrame, peers: DataFrame) -> DataFrame:
    """F-11: medians floored at 1e-9 (rates) / 1 (counts), strength clamped 0..100."""
    med = peer_medians_variant(peers, user_tag)
    t = user_tag.withColumnRenamed("user_key", "target_key").join(med, ["target_key", "tag"], "left")
    acc = F.least(F.col("acceptance_rate") / F.greatest(F.coalesce("med_acceptance", F.lit(0.0)), F.lit(1e-9)), F.lit(1.0))
    dif = F.least(F.col("difficulty_score") / F.greatest(F.coalesce("med_difficulty", F.lit(0.0)), F.lit(1e-9)), F.lit(1.0))
    spe = F.least(F.col("specialization_score") / F.greatest(F.coalesce("med_specialization", F.lit(0.0)), F.lit(1e-9)),
                  F.lit(1.0))
    vol = F.lit(1.0) - F.exp(-F.col("ac_count") / F.greatest(F.coalesce("med_ac_count", F.lit(0.0)), F.lit(1.0)))
    # a tag without peer rows scores 0
    s = F.when(F.col("med_ac_count").isNull(), F.lit(0.0)).otherwise(
        fx.clip(fx.peer_strength(acc, dif, spe, vol), 0.0, 100.0))
    return t.select("target_key", "tag", s.alias("strength"), F.coalesce("med_strength", F.lit(0.0)).alias(
        "peer_median_strength"))
