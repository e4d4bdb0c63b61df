"""Exact quantiles without a sort in one task (M-28)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Equal ranges counted in one pass, and most rows of the last range whose values come to the driver.
RANGES, LAST = 1024, 4096


def value_at(df: DataFrame, column: str, rank: int, low: float, high: float) -> float:
    """The ``rank``-th smallest value (from 0) of a numeric column without nulls or NaN, all in [low, high].

    Each pass counts the rows of RANGES equal ranges by a partial aggregate and keeps the range that holds the rank (its own least and
    greatest value), until that has few rows or one value: log(span) / log(RANGES) passes at most, RANGES rows shuffled a task."""
    x = F.col(column).cast("double")
    while low < high:
        inside = df.where((x >= low) & (x <= high))
        place = F.least(F.floor((x - low) / (high - low) * RANGES), F.lit(RANGES - 1))
        found = inside.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
        for r in sorted(found, key=lambda r: r["p"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["lo"], r["hi"]
        if low < high and r["n"] <= LAST:
            return sorted(v[0] for v in df.where((x >= low) & (x <= high)).select(x).collect())[rank]
    return low


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Quantile with linear interpolation between the two values around q * (n - 1); nulls and NaN are left out; None for no value.

    ``df`` is read a few times: pass a written table of the one column."""
    own = df.select(column).where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    n, low, high = own.agg(F.count(F.lit(1)), F.min(column), F.max(column)).first()
    if not n:
        return None
    at = q * (n - 1)
    lower = value_at(own, column, math.floor(at), float(low), float(high))
    if at == math.floor(at):
        return lower
    upper = value_at(own, column, math.floor(at) + 1, float(low), float(high))
    return lower + (upper - lower) * (at - math.floor(at))
