"""Column-expression formulas (no UDFs: every function returns a ``Column``)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_RATING, PEER_WEIGHTS, SMOOTHING, STRENGTH_WEIGHTS, TAG_LABELS, VOLUME_CAP


def lit(x) -> Column:
    return F.lit(x)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; null stays null."""
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def clip01(c: Column) -> Column:
    return clip(c, 0.0, 1.0)


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (ANSI safe)."""
    return F.try_divide(num.cast("double"), F.when(den != 0, den).cast("double"))


# F-1 .. F-6: components of the skill score -------------------------------

def smoothed_acceptance(ac: Column, n: Column) -> Column:
    """(ac + 1) / (n + 2) (F-1)."""
    return (ac + F.lit(SMOOTHING * 0.5)) / (n + F.lit(SMOOTHING))


def difficulty_score(avg_solved: Column) -> Column:
    """clip(avg rating solved / 3500) (F-2)."""
    return clip01(avg_solved / F.lit(float(MAX_RATING)))


def rating_boost(rating: Column, max_rating: Column) -> Column:
    """clip((r + rmax) / 7000) (F-3); null when either rating is null (V-25)."""
    return clip01((rating + max_rating) / F.lit(2.0 * MAX_RATING))


def efficiency_score(first_try: Column) -> Column:
    """clip(first-try rate) (F-4)."""
    return clip01(first_try)


def volume_score(ac: Column) -> Column:
    """clip(ln(1+ac)/ln(51)) (F-5)."""
    return clip01(F.log1p(ac) / F.lit(math.log1p(VOLUME_CAP)))


def specialization_score(ac: Column, total_ac: Column) -> Column:
    """clip(ac / total_ac), 0 when total is 0 or null (F-6)."""
    return F.coalesce(clip01(safe_div(ac, total_ac)), F.lit(0.0))


def tag_strength(components: dict[str, Column] | None = None) -> Column:
    """Weighted sum of the six components, nulls as 0, clipped to [0,1] (F-7, F-8)."""
    comps = components or {k: F.col(k) for k in STRENGTH_WEIGHTS}
    total = None
    for name, w in STRENGTH_WEIGHTS.items():
        term = F.coalesce(comps[name], F.lit(0.0)) * F.lit(w)
        total = term if total is None else total + term
    return clip01(total)


# F-9 / F-10: peer-relative sub-scores --------------------------------------

def ratio_score(user: Column, peer: Column) -> Column:
    """min(user/peer, 1) when peer > 0, else 1 if user > 0 else 0."""
    return (
        F.when(peer > 0, F.least(user / peer, F.lit(1.0)))
        .when(user > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def difficulty_ratio(avg_diff: Column, solved: Column, peer: Column) -> Column:
    return (
        F.when((peer > 0) & (solved > 0), F.least(avg_diff / peer, F.lit(1.0)))
        .when(solved > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def volume_ratio(solved: Column, peer: Column) -> Column:
    """1 - exp(-solved / peer) when peer > 0, else 1 if solved > 0 else 0."""
    return (
        F.when(peer > 0, F.lit(1.0) - F.exp(-solved / peer))
        .when(solved > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def peer_strength(acc: Column, diff: Column, spec: Column, vol: Column) -> Column:
    """0-100 strength before rounding (F-10)."""
    w = PEER_WEIGHTS
    return F.lit(100.0) * (
        F.lit(w["acceptance"]) * acc
        + F.lit(w["difficulty"]) * diff
        + F.lit(w["specialization"]) * spec
        + F.lit(w["volume"]) * vol
    )


# F-19 .. F-28 --------------------------------------------------------------

def difficulty_match(solve_score: Column) -> Column:
    return (solve_score + F.lit(1.0)) / F.lit(2.0)


def difficulty_match_variant(solve_score: Column) -> Column:
    """F-19 of the variant: the sweet spot [-0.2, 0.8] moved to [0, 1]."""
    return solve_score + F.lit(0.2)


def difficulty_label(attempts: Column) -> Column:
    """F-22: <1.5 easy, <2.5 moderate, else hard."""
    return F.when(attempts < 1.5, "easy").when(attempts < 2.5, "moderate").otherwise("hard")


def min_max_normalise(v: Column, lo: Column, hi: Column) -> Column:
    """F-26: (v - lo) / (hi - lo), 0 when the range is 0."""
    return F.when(hi - lo == 0, F.lit(0.0)).otherwise((v - lo) / (hi - lo))


def tag_label(tag: Column) -> Column:
    """F-27: drop a ``tag_`` prefix, underscores to spaces."""
    return F.regexp_replace(F.regexp_replace(tag, "^tag_", ""), "_", " ")


def long_tag_label(tag: Column) -> Column:
    """F-27, long form: the display name of a tag of the vocabulary, any other tag itself."""
    names = F.create_map(*[F.lit(x) for pair in TAG_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(names, tag), tag)


def at_sink(value: Column, digits: int) -> Column:
    """Rounding at a sink (F-10, F-21), half up; float noise below 1e-9 does not decide a half."""
    return F.round(F.round(value, 9), digits)


def round_to_100(r: Column) -> Column:
    """Half-up rounding to the nearest 100 (F-28)."""
    return (F.floor(r / 100.0 + 0.5) * 100).cast("int")


def plan_bounds(rating: Column) -> list[Column]:
    """F-29: comfort floor, comfort ceiling, stretch ceiling."""
    return [
        F.greatest(F.lit(800), rating - 300).alias("comfort_floor"),
        F.least(F.lit(3500), rating + 100).alias("comfort_ceiling"),
        F.least(F.lit(3500), rating + 300).alias("stretch_ceiling"),
    ]


# F-32: time helpers ----------------------------------------------------------

def epoch_micros_ntz(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` value, without any
    session time zone (a difference of two zone-less timestamps)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_seconds_ntz(ts: Column) -> Column:
    """Whole seconds since the epoch (floor) of a ``timestamp_ntz`` value."""
    return F.floor(epoch_micros_ntz(ts) / F.lit(1_000_000)).cast("long")
