"""Registered queries: cleaning, profiles, skill table (E-6, A-22, E-1 and parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import skill as S
from . import sql_blocks as Q
from .catalog import register, rounded_select

# ---------------------------------------------------------------- E-6 cleaning
_CLEAN_COLS = ["user_key", "item", "item_rating", "tags_csv", "is_ac", "is_wa", "submitted_at", "attempt_id"]


@register(
    "attempts_clean",
    Q.with_(Q.ATT_SCALE, Q.clean())
    + " SELECT user_key, item, item_rating, array_to_string(tags, ',') AS tags_csv, is_ac, is_wa, submitted_at, attempt_id FROM clean",
)
def attempts_clean(inp):
    """E-6: verdict consolidation, undecided/null/no-signal drops, activity filter."""
    return inp.attempts().select(
        "user_key", "item", "item_rating", F.array_join("tags", ",").alias("tags_csv"),
        "is_ac", "is_wa", "submitted_at", "attempt_id",
    )


# ---------------------------------------------------------------- A-22 profiles
_PROFILE_COLS = [
    "user_key", "unique_problems_solved", "unique_problems_tried", "first_try_rate", "avg_attempts_to_ac",
    "solved_lte_1000", "solved_1001_1500", "solved_1501_2000", "solved_2001_2500", "solved_2501_3000",
    "solved_gt_3000", "total_ac", "unique_tags_solved", "tag_coverage_pct", "cf_rating", "cf_max_rating",
]
_PROFILE_DBL = ["first_try_rate", "avg_attempts_to_ac", "tag_coverage_pct"]


@register(
    "user_profiles",
    Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles())
    + f" SELECT {rounded_select(_PROFILE_COLS, _PROFILE_DBL)} FROM profiles",
)
def user_profiles(inp):
    """A-22 / A-20(b): profile activity columns derived from cleaned attempts."""
    return inp.profiles().select(*_PROFILE_COLS)


# ---------------------------------------------------------------- E-1 skill table
_UT_COLS = [
    "user_key", "tag", "total_attempts", "ac_count", "wa_count", "avg_rating_attempted", "max_rating_solved",
    "avg_rating_solved", "acceptance_rate", "difficulty_score", "rating_boost", "efficiency_score",
    "volume_score", "specialization_score", "tag_strength",
]
_UT_DBL = _UT_COLS[5:]


@register(
    "user_tag_strength",
    Q.with_(Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag())
    + f" SELECT {rounded_select(_UT_COLS, _UT_DBL)} FROM user_tag",
)
def user_tag_strength(inp):
    """E-1: per-(user, tag) aggregates, profile join and the weighted strength."""
    return inp.user_tag().select(*_UT_COLS)
