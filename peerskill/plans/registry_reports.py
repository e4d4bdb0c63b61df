"""Registered queries: enriched profiles, reports and the variant formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RANK_ORDER, TAGS
from ..operators import benchmark as B
from ..operators import evaluate as EV
from ..operators import recommend as R
from ..operators import reports as RP
from ..operators import skill as S
from . import sql_blocks as Q
from .catalog import register, rounded_select

_UT = [Q.ATT_SCALE, Q.clean(), Q.profiles(), Q.user_tag()]
_PEERS = _UT + [Q.TAG_DIM, Q.vectors(), Q.peers()]
_RANK_CASE = ("CASE WHEN cf_rating IS NULL THEN NULL " + " ".join(
    f"WHEN cf_rating < {b} THEN '{lab}'" for b, lab in zip([1200, 1400, 1600, 1900, 2100, 2300, 2400], RANK_ORDER))
    + f" ELSE '{RANK_ORDER[-1]}' END")

_ENR = (["user_key", "cf_rating", "total_ac"] + [f"strength_{t}" for t in TAGS]
        + ["strongest_tag_computed", "strongest_tag_score", "weakest_tag_computed", "weakest_tag_score"])
_ENR_DBL = [f"strength_{t}" for t in TAGS] + ["strongest_tag_score", "weakest_tag_score"]
_ENR_SQL = Q.with_(*_UT, Q.TAG_DIM, """
piv AS (SELECT user_key, """ + ", ".join(f"avg(tag_strength) FILTER (WHERE tag = '{t}') AS strength_{t}" for t in TAGS)
    + """ FROM user_tag GROUP BY user_key),
st AS (SELECT user_key, tag AS strongest_tag_computed, tag_strength AS strongest_tag_score FROM (
  SELECT u.*, row_number() OVER (PARTITION BY user_key ORDER BY tag_strength DESC, d.ord) AS rn
  FROM user_tag u JOIN tag_dim d USING (tag)) WHERE rn = 1),
wk AS (SELECT user_key, tag AS weakest_tag_computed, tag_strength AS weakest_tag_score FROM (
  SELECT u.*, row_number() OVER (PARTITION BY user_key ORDER BY tag_strength, d.ord) AS rn
  FROM user_tag u JOIN tag_dim d USING (tag) WHERE ac_count > 0) WHERE rn = 1),
enr AS (SELECT p.user_key, p.cf_rating, p.total_ac, piv.* EXCLUDE (user_key), st.* EXCLUDE (user_key), wk.* EXCLUDE (user_key)
        FROM profiles p LEFT JOIN piv USING (user_key) LEFT JOIN st USING (user_key) LEFT JOIN wk USING (user_key))""")


@register("enriched_profiles", _ENR_SQL + f" SELECT {rounded_select(_ENR, _ENR_DBL)} FROM enr")
def enriched_profiles(inp):
    """J-2 / A-8 / A-10 / A-11: profiles + strength pivot + strongest / weakest tag."""
    return S.enriched_profiles(inp.profiles(), inp.user_tag()).select(*_ENR)


@register("distinct_users", Q.with_(*_UT) + " SELECT count(DISTINCT user_key) AS n_users FROM user_tag")
def distinct_users(inp):
    """A-24: distinct users in the skill table."""
    return RP.distinct_users(inp.user_tag())


@register("rows_per_user", Q.with_(*_UT) + " SELECT user_key, count(*) AS n_rows FROM user_tag GROUP BY user_key HAVING count(*) > 17")
def rows_per_user(inp):
    """A-25: users with more than 17 skill rows."""
    return RP.rows_per_user(inp.user_tag())


_EDGES = [0, 800, 1000, 1200, 1400, 1600, 1800, 2000, 2200, 2500, 9999]
_BIN_CASE = "CASE " + " ".join(f"WHEN item_rating > {lo} AND item_rating <= {hi} THEN '({lo},{hi}]'"
                               for lo, hi in zip(_EDGES[:-1], _EDGES[1:])) + " END"


@register("acceptance_by_rating_bin", Q.with_(Q.ATT_SCALE, Q.clean())
          + f" SELECT rating_bin, round(avg(is_ac), 6) AS acceptance, count(*) AS n FROM (SELECT *, {_BIN_CASE} AS rating_bin"
            " FROM clean) WHERE rating_bin IS NOT NULL GROUP BY rating_bin")
def acceptance_by_rating_bin(inp):
    """A-29: mean acceptance per right-closed rating bin over cleaned attempts."""
    return RP.acceptance_by_rating_bin(inp.attempts())


@register("rank_distribution", Q.with_(*_UT) + f""" SELECT cf_rank, CAST(rank_order AS INTEGER) AS rank_order, n,
      round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM (
        SELECT {_RANK_CASE} AS cf_rank, count(*) AS n FROM profiles GROUP BY 1) r
      JOIN (SELECT unnest({RANK_ORDER!r}) AS cf_rank, generate_subscripts({RANK_ORDER!r}, 1) AS rank_order) o USING (cf_rank)""")
def rank_distribution(inp):
    """A-30: users per rank label, in ladder order."""
    return RP.rank_distribution(inp.profiles())


@register("dataset_summary", Q.with_(*_UT, Q.per_item("clean", "dpi")) + """ SELECT count(*) AS n_users,
      min(cf_rating) AS min_rating, max(cf_rating) AS max_rating, round(avg(first_try_rate), 6) AS mean_first_try,
      round(stddev_pop(first_try_rate), 6) AS std_first_try, (SELECT CAST(sum(n_attempts) AS BIGINT) FROM dpi) AS n_attempts
      FROM profiles WHERE user_key IN (SELECT user_key FROM dpi)""")
def dataset_summary(inp):
    """A-31: users, attempts, rating range, first-try mean and population std."""
    return RP.dataset_summary(inp.pairs(), inp.profiles())


@register("mean_acceptance_over_tags", Q.with_(*_UT)
          + " SELECT user_key, round(sum(acceptance_rate) / 20.0, 6) AS mean_acceptance FROM user_tag GROUP BY user_key")
def mean_acceptance_over_tags(inp):
    """A-36: mean of the 20 tag acceptance rates per user."""
    return RP.mean_acceptance_over_tags(inp.user_tag())


@register("difficulty_label_counts", Q.with_(*_PEERS, Q.recommend()) + """ SELECT target_key, difficulty_label, count(*) AS n FROM (
      SELECT target_key, CASE WHEN estimated_attempts < 1.5 THEN 'easy' WHEN estimated_attempts < 2.5 THEN 'moderate'
             ELSE 'hard' END AS difficulty_label FROM recs WHERE estimated_attempts IS NOT NULL) GROUP BY 1, 2""")
def difficulty_label_counts(inp):
    """A-41: easy / moderate / hard counts over each user's top 50."""
    return RP.label_counts(inp.recommendations())


@register("weakest_strongest_tags", Q.with_(*_PEERS, Q.item_stats(), Q.bench()) + """ SELECT target_key, tag, round(strength, 6) AS strength,
      CAST(CASE WHEN wp <= 5 THEN wp ELSE 0 END AS INTEGER) AS weak_pos, CAST(CASE WHEN sp <= 5 THEN sp ELSE 0 END AS INTEGER) AS strong_pos FROM (
        SELECT b.*, row_number() OVER (PARTITION BY target_key ORDER BY strength, d.ord) AS wp,
               row_number() OVER (PARTITION BY target_key ORDER BY strength DESC, d.ord) AS sp
        FROM bench b JOIN tag_dim d USING (tag) WHERE attempted >= 1) WHERE wp <= 5 OR sp <= 5""")
def weakest_strongest_tags(inp):
    """L-4: five weakest and five strongest attempted tags per user (peer-benchmark scale)."""
    return RP.weakest_strongest(inp.peer_benchmark())


_M27 = """
zs AS (SELECT u.user_key, d.tag, coalesce(t.tag_strength, 0.0) AS s
       FROM (SELECT DISTINCT user_key FROM user_tag) u CROSS JOIN tag_dim d
       LEFT JOIN user_tag t ON t.user_key = u.user_key AND t.tag = d.tag),
m27 AS (SELECT z.user_key AS target_key, z.tag, z.s AS target_strength, c.peer_mean FROM zs z JOIN (
          SELECT p.target_key, zs.tag, avg(zs.s) AS peer_mean FROM peers p JOIN zs ON zs.user_key = p.peer_key GROUP BY 1, 2) c
        ON c.target_key = z.user_key AND c.tag = z.tag)"""


@register("target_vs_peer_profile", Q.with_(*_PEERS, _M27)
          + " SELECT target_key, tag, round(target_strength, 6) AS target_strength, round(peer_mean, 6) AS peer_mean FROM m27")
def target_vs_peer_profile(inp):
    """M-27: each user's tag strengths beside the mean of its peers."""
    return RP.target_vs_peer_profile(inp.peers(), EV.zero_filled_strengths(inp.user_tag_table(), inp.user_tag_table()))


@register("recommendation_quadrants", Q.with_(*_PEERS, Q.recommend()) + """ SELECT boost_half, match_half, count(*) AS n,
      round(any_value(med), 6) AS median_boost FROM (
        SELECT CASE WHEN weakness_boost >= (SELECT median(weakness_boost) FROM recs) THEN 'high_boost' ELSE 'low_boost' END AS boost_half,
               CASE WHEN difficulty_match >= 0.5 THEN 'reachable' ELSE 'stretch' END AS match_half,
               (SELECT median(weakness_boost) FROM recs) AS med FROM recs) GROUP BY 1, 2""")
def recommendation_quadrants(inp):
    """M-28: recommendations split by median weakness boost and the 0.5 match line."""
    return RP.recommendation_quadrants(inp.recommendations())


_VAR_SQL = """
vmed AS (SELECT p.target_key, u.tag, median(u.acceptance_rate) AS med_acceptance, median(u.difficulty_score) AS med_difficulty,
                median(u.specialization_score) AS med_specialization, median(CAST(u.ac_count AS DOUBLE)) AS med_ac_count,
                median(u.tag_strength) AS med_strength
         FROM peers p JOIN user_tag u ON u.user_key = p.peer_key GROUP BY 1, 2),
var AS (SELECT t.user_key AS target_key, t.tag,
   CASE WHEN m.med_ac_count IS NULL THEN 0.0 ELSE least(greatest(100.0 * (
        0.35 * least(t.acceptance_rate / greatest(coalesce(m.med_acceptance, 0.0), 1e-9), 1.0)
      + 0.35 * least(t.difficulty_score / greatest(coalesce(m.med_difficulty, 0.0), 1e-9), 1.0)
      + 0.1 * least(t.specialization_score / greatest(coalesce(m.med_specialization, 0.0), 1e-9), 1.0)
      + 0.2 * (1.0 - exp(-t.ac_count / greatest(coalesce(m.med_ac_count, 0.0), 1.0)))), 0.0), 100.0) END AS strength,
   coalesce(m.med_strength, 0.0) AS peer_median_strength
  FROM user_tag t LEFT JOIN vmed m ON m.target_key = t.user_key AND m.tag = t.tag)"""


@register("peer_strength_variant", Q.with_(*_PEERS, _VAR_SQL)
          + " SELECT target_key, tag, round(strength, 6) AS strength, round(peer_median_strength, 6) AS peer_median_strength FROM var")
def peer_strength_variant(inp):
    """A-13 / A-14 / F-11: the variant peer strength from stored component medians."""
    return B.peer_strength_variant(inp.user_tag_table(), inp.peers())


@register("candidate_pool_rr", Q.with_(*_PEERS, Q.recommend().replace("p.similarity / 100.0", "1.0 / p.rank")
                                          .replace("<= 200", "<= 300"))
          + " SELECT target_key, item, item_rating, round(collab_score, 6) AS collab_score, pool_rank FROM pool")
def candidate_pool_rr(inp):
    """A-17 / W-9: candidate pool with reciprocal-rank peer weights, top 300."""
    return R.collaborative_candidates_rr(inp.peers(), inp.pairs_table(), inp.items()).select(
        "target_key", "item", "item_rating", "collab_score", "pool_rank")
