"""Projections, filters and cleaning (P-1 .. P-23, E-6).

Every function is ``DataFrame -> DataFrame``; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import MIN_ACCEPTED, RAW_TAG_MAP, TAGS, VERDICT_FAIL, VERDICT_OK


# P-1 .. P-5 ------------------------------------------------------------------

def item_key_expr(contest_id: Column, index: Column) -> Column:
    """P-1: ``{contestId}_{index}``, a missing part becomes empty."""
    return F.concat(F.coalesce(contest_id.cast("string"), F.lit("")), F.lit("_"), F.coalesce(index, F.lit("")))


def verdict_flags(verdict: Column) -> list[Column]:
    """P-2 / P-3: is_ac, is_wa (WA or TLE or MLE), is_tle, is_mle as tinyint."""
    return [
        F.coalesce((verdict == VERDICT_OK).cast("tinyint"), F.lit(0).cast("tinyint")).alias("is_ac"),
        F.coalesce(verdict.isin(*VERDICT_FAIL).cast("tinyint"), F.lit(0).cast("tinyint")).alias("is_wa"),
        F.coalesce((verdict == "TIME_LIMIT_EXCEEDED").cast("tinyint"), F.lit(0).cast("tinyint")).alias("is_tle"),
        F.coalesce((verdict == "MEMORY_LIMIT_EXCEEDED").cast("tinyint"), F.lit(0).cast("tinyint")).alias("is_mle"),
    ]


def verdict_whitelist(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """P-4 (variant): keep OK/WA/TLE/MLE/RE only; every non-OK counts as WA."""
    keep = ["OK", "WRONG_ANSWER", "TIME_LIMIT_EXCEEDED", "MEMORY_LIMIT_EXCEEDED", "RUNTIME_ERROR"]
    v = F.col(verdict)
    return (
        df.filter(v.isin(*keep))
        .withColumn("is_ac", (v == "OK").cast("tinyint"))
        .withColumn("is_wa", (v != "OK").cast("tinyint"))
    )


def tag_map_column() -> Column:
    """Literal map raw tag -> canonical tag (20 canonical tags; small and fixed)."""
    kv = []
    for raw, tag in RAW_TAG_MAP.items():
        kv += [F.lit(raw), F.lit(tag)]
    return F.create_map(*kv)


def normalise_tags(raw_tags: Column) -> Column:
    """P-5: lower-case raw tags, map to canonical, drop unknown, distinct."""
    m = tag_map_column()
    mapped = F.transform(raw_tags, lambda t: F.element_at(m, F.lower(F.trim(t))))
    return F.array_distinct(F.filter(mapped, lambda x: x.isNotNull()))


def tag_flag_columns(tags: Column, prefix: str = "tag_") -> list[Column]:
    """20 binary flags (multi-hot) from a tag array."""
    return [F.coalesce(F.array_contains(tags, t), F.lit(False)).cast("tinyint").alias(prefix + t) for t in TAGS]


def tags_from_flags(prefix: str = "tag_") -> Column:
    """Inverse of :func:`tag_flag_columns` (wide CSV edge -> array)."""
    return F.filter(
        F.array(*[F.when(F.col(prefix + t) == 1, F.lit(t)) for t in TAGS]), lambda x: x.isNotNull()
    )


# P-6 .. P-12: the cleaning job ------------------------------------------------

def consolidate_verdicts(df: DataFrame) -> DataFrame:
    """P-6: is_wa becomes is_wa OR is_tle OR is_mle."""
    return df.withColumn("is_wa", F.greatest("is_wa", "is_tle", "is_mle").cast("tinyint"))


def drop_undecided(df: DataFrame) -> DataFrame:
    """P-7: remove rows that are neither accepted nor rejected."""
    return df.filter((F.col("is_ac") != 0) | (F.col("is_wa") != 0))


def drop_null_items(df: DataFrame, col: str = "item") -> DataFrame:
    """P-8."""
    return df.filter(F.col(col).isNotNull())


def select_prefixed(df: DataFrame, base: list[str], prefix: str = "tag_") -> DataFrame:
    """P-9: base columns plus every column with the prefix."""
    return df.select(*base, *[c for c in df.columns if c.startswith(prefix) and c not in base])


def accepted_per_user(df: DataFrame) -> DataFrame:
    return df.groupBy("user_key").agg(F.sum("is_ac").cast("bigint").alias("n_ac"))


def min_activity_filter(df: DataFrame, min_accepted: int = MIN_ACCEPTED, strict: bool = False) -> DataFrame:
    """P-10: drop users with 0 < AC < min (users without AC survive, V-9).
    P-11 (``strict=True``): keep only users with AC >= min.

    The per-user count is a partial/final aggregate (one row per user) and
    the filter is a semi/anti join on user_key."""
    per_user = accepted_per_user(df)
    if strict:
        keep = per_user.filter(F.col("n_ac") >= min_accepted).select("user_key")
        return df.join(keep, "user_key", "left_semi")
    drop = per_user.filter((F.col("n_ac") > 0) & (F.col("n_ac") < min_accepted)).select("user_key")
    return df.join(drop, "user_key", "left_anti")


def drop_no_signal_items(df: DataFrame) -> DataFrame:
    """P-12: drop rows whose item is unrated and untagged."""
    return df.filter(~((F.coalesce(F.col("item_rating"), F.lit(0)) == 0) & (F.size("tags") == 0)))


def drop_unrated(df: DataFrame, col: str = "item_rating") -> DataFrame:
    """P-13: rating coerced to a number, keep > 0."""
    return df.filter(F.expr(f"try_cast({col} as double)") > 0)


def decided(df: DataFrame) -> DataFrame:
    """P-6 -> P-7 -> P-8: the narrow, row-level part of the cleaning."""
    return drop_null_items(drop_undecided(consolidate_verdicts(df)))


def clean_attempts(df: DataFrame, items: DataFrame, min_accepted: int = MIN_ACCEPTED,
                   strict: bool = False) -> DataFrame:
    """E-6 at row level: P-6 -> P-7 -> P-8 -> P-10 -> P-12 (the AC count of
    P-10 is taken before P-12 drops no-signal items; tags come from the item
    dimension)."""
    out = min_activity_filter(decided(df), min_accepted, strict)
    return drop_no_signal_items(out.join(items.select("item", "tags"), "item"))


# P-14 .. P-23 ----------------------------------------------------------------

def clean_handles(df: DataFrame, col: str = "handle", observed: Observation | None = None) -> DataFrame:
    """P-14 (F-31 string helpers: strip, lstrip set, compare): strip any whitespace, then leading ``=+-@``; drop '#NAME?', null, empty.

    Strip first, then test (V-24): ``=#NAME?`` cleans to ``#NAME?`` and is dropped.  ``observed`` takes the number of rows read and
    dropped from the same pass over the rows; its ``get`` waits for the first action on the result."""
    stripped = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    cleaned = df.withColumn(col, F.regexp_replace(stripped, r"^[=+\-@]+", ""))
    good = F.col(col).isNotNull() & (F.col(col) != "#NAME?") & (F.length(F.col(col)) > 0)
    if observed is not None:
        cleaned = cleaned.observe(observed, F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(good, F.lit(False))).alias("dropped"))
    return cleaned.filter(good)


def alias_schema_drift(df: DataFrame, old: str = "tag_implementation", new: str = "tag_impl") -> DataFrame:
    """P-15: rename old -> new; when both exist keep the max."""
    cols = set(df.columns)
    if old in cols and new in cols:
        return df.withColumn(new, F.greatest(F.col(new), F.col(old))).drop(old)
    if old in cols:
        return df.withColumnRenamed(old, new)
    return df


def null_to_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P-16."""
    return df.fillna(0, subset=cols) if cols else df.fillna(0)


def rating_range(df: DataFrame, col: str = "cf_rating", lo: int = 900, hi: int = 3500) -> DataFrame:
    """P-17."""
    return df.filter(F.col(col).between(lo, hi))


def recent_window(df: DataFrame, ts_col: str, since: Column) -> DataFrame:
    """P-18: keep rows at or after ``since`` (pass ``now`` as a parameter, F-32)."""
    return df.filter(F.col(ts_col) >= since)


def finished_window(contests: DataFrame, since: Column) -> DataFrame:
    """P-18 on contests (contest, phase, start_second, duration_seconds): finished ones whose end is not before ``since`` (epoch seconds).
    A missing start or duration counts as 0."""
    end = F.coalesce("start_second", F.lit(0)) + F.coalesce("duration_seconds", F.lit(0))
    return contests.filter((F.col("phase") == "FINISHED") & (end >= since))


def conditional_history(df: DataFrame, known_users: DataFrame, ts_col: str, since: Column) -> DataFrame:
    """P-19: new users keep all history, known users only rows since ``since``."""
    known = known_users.select("user_key").distinct().withColumn("_known", F.lit(True))
    return (
        df.join(known, "user_key", "left")
        .filter(F.col("_known").isNull() | (F.col(ts_col) >= since))
        .drop("_known")
    )


def sweet_spot(df: DataFrame, col: str = "solve_score", lo: float = -0.2, hi: float = 0.8) -> DataFrame:
    """P-20."""
    return df.filter(F.col(col).between(lo, hi))


def attempted_only(df: DataFrame, col: str = "attempted", n: int = 1) -> DataFrame:
    """P-22."""
    return df.filter(F.col(col) >= n)


def tagged_only(df: DataFrame, col: str = "tags") -> DataFrame:
    """P-23."""
    return df.filter(F.size(col) > 0)
