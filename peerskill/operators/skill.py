"""Per-(user, tag) skill table and user profiles (A-1..A-11, A-19..A-23, J-1, J-2, E-1).

Grain rules:
* "attempt" aggregates (A-4) count attempt rows,
* "item" aggregates (A-1/A-5) first collapse to one row per (user, item).
All aggregates are plain hash aggregates (partial + final), so a hot user only
adds work to the final merge of one small per-key partial state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STRENGTH_WEIGHTS, TAGS
from ..functions import formulas as fx


# A-1 / A-2 / A-3: per-(user, item) collapse ---------------------------------

def per_item(attempts: DataFrame) -> DataFrame:
    """One row per (user, item) - the grain every later stage starts from.

    n_attempts, n_ac, n_wa (attempt-row counts), ever_ac, wa_count and
    ``first_is_ac``: the verdict of the earliest attempt by
    (submitted_at, attempt_id), exact ties preferring AC (V-4).  One shuffle
    on (user, item) with map-side partial aggregation."""
    from .ordered import order_key_num

    first = F.min(order_key_num(F.lit(1) - F.col("is_ac")))
    return attempts.groupBy("user_key", "item").agg(
        F.max("item_rating").alias("item_rating"),
        F.count(F.lit(1)).alias("n_attempts"),
        F.sum("is_ac").cast("bigint").alias("n_ac"),
        F.sum("is_wa").cast("bigint").alias("n_wa"),
        F.max("is_ac").cast("int").alias("ever_ac"),
        (F.lit(1) - F.pmod(first, F.lit(10).cast("decimal(38,0)"))).cast("int").alias("first_is_ac"),
    ).withColumn("wa_count", F.col("n_wa"))


def with_tags(df: DataFrame, items: DataFrame) -> DataFrame:
    """Attach the item's tag array (item dimension join; AQE broadcasts it
    at runtime when it is small)."""
    return df.join(items.select("item", "tags"), "item")


def clean_pairs(pairs: DataFrame, items: DataFrame, min_accepted: int, strict: bool = False) -> DataFrame:
    """P-10 / P-11 and P-12 at the (user, item) grain: the user's accepted
    count is the sum of n_ac (taken before P-12), no-signal items are an item
    attribute."""
    per_user = pairs.groupBy("user_key").agg(F.sum("n_ac").alias("n_ac"))
    if strict:
        keep = per_user.filter(F.col("n_ac") >= min_accepted).select("user_key")
        out = pairs.join(keep, "user_key", "left_semi")
    else:
        drop = per_user.filter((F.col("n_ac") > 0) & (F.col("n_ac") < min_accepted)).select("user_key")
        out = pairs.join(drop, "user_key", "left_anti")
    no_signal = items.filter((F.coalesce(F.col("item_rating"), F.lit(0)) == 0) & (F.size("tags") == 0)).select("item")
    return out.join(no_signal, "item", "left_anti")


# A-20 / A-22: profile derivation ---------------------------------------------

def derive_profiles(pairs: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """A-22: activity columns of the profile, derived from the cleaned
    (user, item) table and joined to the rating columns (users with attempts).

    total_ac           = accepted attempt rows
    first_try_rate     = share of distinct items whose earliest attempt is AC (A-20 b)
    avg_attempts_to_ac = mean attempts on solved items
    unique_problems_*  = distinct solved / tried items
    unique_tags_solved, tag_coverage_pct, solved_* rating bands
    """
    r = F.col("item_rating")
    solved = F.col("ever_ac") == 1
    bands = [
        ("solved_lte_1000", r <= 1000),
        ("solved_1001_1500", (r > 1000) & (r <= 1500)),
        ("solved_1501_2000", (r > 1500) & (r <= 2000)),
        ("solved_2001_2500", (r > 2000) & (r <= 2500)),
        ("solved_2501_3000", (r > 2500) & (r <= 3000)),
        ("solved_gt_3000", r > 3000),
    ]
    per_user = pairs.groupBy("user_key").agg(
        F.count_if(solved).cast("bigint").alias("unique_problems_solved"),
        F.count(F.lit(1)).cast("bigint").alias("unique_problems_tried"),
        F.avg("first_is_ac").alias("first_try_rate"),
        F.coalesce(F.avg(F.when(solved, F.col("n_attempts"))), F.lit(0.0)).alias("avg_attempts_to_ac"),
        *[F.count_if(solved & (r > 0) & cond).cast("bigint").alias(name) for name, cond in bands],
        F.sum("n_ac").cast("bigint").alias("total_ac"),
    )
    tags_solved = (
        with_tags(pairs.filter(solved).select("user_key", "item"), items)
        .select("user_key", F.explode("tags").alias("tag"))
        .groupBy("user_key")
        .agg(F.countDistinct("tag").cast("bigint").alias("unique_tags_solved"))
    )
    prof = (
        per_user.join(tags_solved, "user_key", "left")
        .withColumn("unique_tags_solved", F.coalesce("unique_tags_solved", F.lit(0).cast("bigint")))
        .withColumn("tag_coverage_pct", F.col("unique_tags_solved") * 100.0 / len(TAGS))
    )
    return prof.join(ratings, "user_key", "inner")


# A-4: per-(user, tag) aggregate over attempt rows -------------------------------

def user_tag_aggregate(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """A-4 at attempt grain (A-7: the tag unpivot is an explode of the item's
    active-tag array; X-2: the group-apply lambdas are conditional
    aggregates), computed from the (user, item) table: every
    attempt row of an item counts once for each of the item's tags, so the
    per-tag counts are sums of the per-item counts and the attempt-weighted
    rating means are sum(n * rating) / sum(n) (exact: ratings are integers)."""
    r = F.col("item_rating").cast("bigint")
    t = with_tags(pairs, items).select(
        "user_key", "n_attempts", "n_ac", "n_wa", r.alias("r"), F.explode("tags").alias("tag")
    )
    return (
        t.groupBy("user_key", "tag")
        .agg(
            F.sum("n_attempts").alias("total_attempts"),
            F.sum("n_ac").alias("ac_count"),
            F.sum("n_wa").alias("wa_count"),
            (F.sum(F.col("n_attempts") * F.col("r")) / F.sum("n_attempts")).alias("avg_rating_attempted"),
            F.coalesce(F.max(F.when(F.col("n_ac") > 0, F.col("r"))), F.lit(0)).cast("double").alias("max_rating_solved"),
            F.coalesce(F.sum(F.col("n_ac") * F.col("r")) / F.when(F.sum("n_ac") > 0, F.sum("n_ac")), F.lit(0.0))
            .alias("avg_rating_solved"),
        )
    )


PROFILE_SIGNALS = ["cf_rating", "cf_max_rating", "first_try_rate", "avg_attempts_to_ac", "tag_coverage_pct", "total_ac"]


def score_components(user_tag: DataFrame) -> DataFrame:
    """F-1..F-8 on a user-tag table that already carries the profile signals."""
    return (
        user_tag.withColumn("acceptance_rate", fx.smoothed_acceptance(F.col("ac_count"), F.col("total_attempts")))
        .withColumn("difficulty_score", fx.difficulty_score(F.col("avg_rating_solved")))
        .withColumn("rating_boost", fx.rating_boost(F.col("cf_rating"), F.col("cf_max_rating")))
        .withColumn("efficiency_score", fx.efficiency_score(F.col("first_try_rate")))
        .withColumn("volume_score", fx.volume_score(F.col("ac_count")))
        .withColumn("specialization_score", fx.specialization_score(F.col("ac_count"), F.col("total_ac")))
        .withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in STRENGTH_WEIGHTS})
        .withColumn("tag_strength", fx.tag_strength())
    )


def user_tag_strengths(pairs: DataFrame, items: DataFrame, profiles: DataFrame) -> DataFrame:
    """E-1 core: A-4 -> J-1 (one left join on user) -> F-1..F-8."""
    agg = user_tag_aggregate(pairs, items)
    prof = profiles.select("user_key", *PROFILE_SIGNALS)
    return score_components(agg.join(prof, "user_key", "left"))


# A-8 / A-10 / A-11 / J-2 --------------------------------------------------------

def strength_pivot(user_tag: DataFrame, value: str = "tag_strength", fill: float | None = 0.0,
                   prefix: str = "strength_") -> DataFrame:
    """A-8: user x 20 tags with an explicit value list (no distinct job)."""
    p = user_tag.groupBy("user_key").pivot("tag", TAGS).agg(F.avg(value))
    p = p.select("user_key", *[F.col(t).alias(prefix + t) for t in TAGS])
    return p.fillna(fill) if fill is not None else p


def _tag_ord():
    return F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))


def strongest_tag(user_tag: DataFrame) -> DataFrame:
    """A-10: argmax strength per user, first in tag order on ties (max_by over
    a struct, one aggregate pass, no window)."""
    key = F.struct(F.col("tag_strength").alias("s"), (-_tag_ord()).alias("o"), F.col("tag").alias("t"))
    return user_tag.groupBy("user_key").agg(F.max(key).alias("_m")).select(
        "user_key",
        F.col("_m.t").alias("strongest_tag_computed"),
        F.col("_m.s").alias("strongest_tag_score"),
    )


def weakest_tag(user_tag: DataFrame) -> DataFrame:
    """A-11: argmin strength among tags with ac_count > 0, first in tag order."""
    key = F.struct(F.col("tag_strength").alias("s"), _tag_ord().alias("o"), F.col("tag").alias("t"))
    return user_tag.filter(F.col("ac_count") > 0).groupBy("user_key").agg(F.min(key).alias("_m")).select(
        "user_key",
        F.col("_m.t").alias("weakest_tag_computed"),
        F.col("_m.s").alias("weakest_tag_score"),
    )


def enriched_profiles(profiles: DataFrame, user_tag: DataFrame) -> DataFrame:
    """J-2: profiles left-joined to pivot (missing -> null), strongest, weakest."""
    return (
        profiles.join(strength_pivot(user_tag, fill=None), "user_key", "left")
        .join(strongest_tag(user_tag), "user_key", "left")
        .join(weakest_tag(user_tag), "user_key", "left")
    )


# A-5: per-(user, tag) stats over distinct items --------------------------------

def user_tag_item_stats(per_item_rows: DataFrame, items: DataFrame, zero_fill: bool = True) -> DataFrame:
    """A-5: solved / attempted distinct items and mean solved rating per tag,
    plus total_solved per user; zero-filled for all 20 tags.

    ``avg_difficulty`` is kept at full precision (rounding only in sinks, V-21)."""
    solved = F.col("ever_ac") == 1
    per_tag = (
        with_tags(per_item_rows, items).select("user_key", "ever_ac", "item_rating", F.explode("tags").alias("tag"))
        .groupBy("user_key", "tag")
        .agg(
            F.count_if(solved).cast("bigint").alias("solved"),
            F.count(F.lit(1)).cast("bigint").alias("attempted"),
            F.coalesce(F.avg(F.when(solved, F.col("item_rating"))), F.lit(0.0)).alias("avg_difficulty"),
        )
    )
    totals = per_item_rows.groupBy("user_key").agg(F.sum("ever_ac").cast("bigint").alias("total_solved"))
    if not zero_fill:
        return per_tag.join(totals, "user_key")
    # users x 20 fixed tags via a generator (narrow, no join)
    grid = totals.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in TAGS])))
    return (
        grid.join(per_tag, ["user_key", "tag"], "left")
        .fillna({"solved": 0, "attempted": 0, "avg_difficulty": 0.0})
    )


def tag_dimension(spark) -> DataFrame:
    """tag_dim(tag, ord, label): 20 fixed rows."""
    rows = [(t, i, t.replace("_", " ")) for i, t in enumerate(TAGS)]
    return spark.createDataFrame(rows, "tag string, ord int, label string")


# A-6 / A-20(a) / A-23: target-side variants ---------------------------------------

def target_side_strength(pairs: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """A-6 (V-3 grain = item): per user and tag over distinct items, with the
    first-try rate (a) = solved items with exactly one attempt / solved items;
    difficulty is not clipped here; 0 for absent tags (all 20 tags)."""
    solved = F.col("ever_ac") == 1
    per_user = pairs.groupBy("user_key").agg(
        F.sum("ever_ac").alias("total_ac_items"),
        F.coalesce(F.count_if(solved & (F.col("n_attempts") == 1)) / F.when(F.count_if(solved) > 0, F.count_if(solved)),
                   F.lit(0.0)).alias("ftr_a"))
    per_tag = (with_tags(pairs, items).select("user_key", "ever_ac", "item_rating", F.explode("tags").alias("tag"))
               .groupBy("user_key", "tag").agg(
                   F.count(F.lit(1)).alias("n"), F.sum("ever_ac").alias("ac"),
                   F.avg(F.when(solved, F.col("item_rating"))).alias("avg_solved")))
    grid = per_user.withColumn("tag", F.explode(F.array(*[F.lit(t) for t in TAGS])))
    j = grid.join(per_tag, ["user_key", "tag"], "left").join(ratings, "user_key", "left")
    comps = {
        "acceptance_rate": fx.smoothed_acceptance(F.col("ac"), F.col("n")),
        "difficulty_score": F.when(F.col("ac") > 0, F.col("avg_solved") / F.lit(3500.0)).otherwise(F.lit(0.0)),
        "rating_boost": F.least((F.col("cf_rating") + F.col("cf_max_rating")) / F.lit(7000.0), F.lit(1.0)),
        "efficiency_score": F.least(F.col("ftr_a"), F.lit(1.0)),
        "volume_score": fx.volume_score(F.col("ac")),
        "specialization_score": F.when(F.col("total_ac_items") > 0,
                                       F.least(F.col("ac") / F.col("total_ac_items"), F.lit(1.0))).otherwise(F.lit(0.0)),
    }
    return j.select("user_key", "tag", F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(fx.tag_strength(comps))
                    .alias("target_strength"))


def global_fallback(pairs: DataFrame) -> DataFrame:
    """A-23: smoothed overall acceptance and solved-rating score over rated
    distinct items, used for unattempted tags when that option is on (V-2)."""
    rated = pairs.filter(F.col("item_rating") > 0)
    return rated.groupBy("user_key").agg(
        F.least((F.sum("ever_ac") + 1.0) / (F.count(F.lit(1)) + 2.0), F.lit(1.0)).alias("global_acceptance"),
        F.least(F.coalesce(F.avg(F.when(F.col("ever_ac") == 1, F.col("item_rating"))), F.lit(0.0)) / 3500.0,
                F.lit(1.0)).alias("global_difficulty"))
