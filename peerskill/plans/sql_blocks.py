"""ANSI-SQL (DuckDB dialect) building blocks for the oracle queries.

Each block is a CTE body; the oracle of a query is ``WITH`` + the blocks it
needs + a final ``SELECT``.  The SQL mirrors the *definitions* of the
operators, written independently of the DataFrame code, so the two can be
compared row by row.
"""

from __future__ import annotations

from ..config import MIN_ACCEPTED, TAGS


def _tags_list(k: str) -> str:
    items = ", ".join(f"CASE WHEN (({k}) * 7 + {i * 3}) % 11 < 2 THEN '{t}' END" for i, t in enumerate(TAGS))
    return f"CASE WHEN ({k}) % 50 = 0 OR ({k}) % 37 = 5 THEN []::VARCHAR[] ELSE [x FOR x IN [{items}] IF x IS NOT NULL] END"


def _rating(k: str) -> str:
    return f"CAST(CASE WHEN ({k}) % 25 = 0 THEN 0 ELSE 800 + 100 * (({k}) % 28) END AS INTEGER)"


def _flags(v: str) -> str:
    return (
        f"CAST(coalesce({v} = 'OK', false) AS TINYINT) AS is_ac, "
        f"CAST(coalesce({v} IN ('WRONG_ANSWER','TIME_LIMIT_EXCEEDED','MEMORY_LIMIT_EXCEEDED'), false) AS TINYINT) AS is_wa, "
        f"CAST(coalesce({v} = 'TIME_LIMIT_EXCEEDED', false) AS TINYINT) AS is_tle, "
        f"CAST(coalesce({v} = 'MEMORY_LIMIT_EXCEEDED', false) AS TINYINT) AS is_mle"
    )


ATT_SCALE = f"""
att_scale_raw AS (
  SELECT o.o_custkey AS user_key, l.l_partkey AS k, l.l_shipdate AS submitted_at,
         l.l_orderkey * 16 + l.l_linenumber AS attempt_id,
         CASE WHEN l.l_returnflag = 'A' THEN 'OK'
              WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN 'OK'
              WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F' THEN 'WRONG_ANSWER'
              WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'TIME_LIMIT_EXCEEDED'
              WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'COMPILATION_ERROR' END AS verdict
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
att_scale AS (
  SELECT CAST(user_key AS BIGINT) AS user_key, 'I_' || CAST(k AS VARCHAR) AS item, CAST(k AS INTEGER) AS item_key,
         {_rating('k')} AS item_rating, {_tags_list('k')} AS tags, verdict,
         {_flags('verdict')}, submitted_at, CAST(attempt_id AS BIGINT) AS attempt_id
  FROM att_scale_raw
)"""

ATT_ORDER = f"""
att_order_raw AS (
  SELECT user_id AS user_key, CAST(json_extract(props, '$.k') AS INTEGER) AS k, ts AS submitted_at,
         event_id AS attempt_id,
         CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'error' THEN 'WRONG_ANSWER'
              WHEN 'click' THEN 'TIME_LIMIT_EXCEEDED' WHEN 'view' THEN 'MEMORY_LIMIT_EXCEEDED'
              WHEN 'signup' THEN 'COMPILATION_ERROR' END AS verdict
  FROM events
),
att_order AS (
  SELECT CAST(user_key AS BIGINT) AS user_key, 'I_' || CAST(k AS VARCHAR) AS item, CAST(k AS INTEGER) AS item_key,
         {_rating('k')} AS item_rating, {_tags_list('k')} AS tags, verdict,
         {_flags('verdict')}, submitted_at, CAST(attempt_id AS BIGINT) AS attempt_id
  FROM att_order_raw
)"""


def clean(src: str = "att_scale", name: str = "clean", min_accepted: int = MIN_ACCEPTED, strict: bool = False) -> str:
    """E-6 on ``src``."""
    if strict:
        users = f"SELECT user_key FROM {name}_c1 GROUP BY user_key HAVING sum(is_ac) >= {min_accepted}"
        keep = f"user_key IN (SELECT user_key FROM {name}_users)"
    else:
        users = (f"SELECT user_key FROM {name}_c1 GROUP BY user_key "
                 f"HAVING sum(is_ac) > 0 AND sum(is_ac) < {min_accepted}")
        keep = f"user_key NOT IN (SELECT user_key FROM {name}_users)"
    return f"""
{name}_c1 AS (
  SELECT * REPLACE (CAST(greatest(is_wa, is_tle, is_mle) AS TINYINT) AS is_wa) FROM {src}
  WHERE (is_ac <> 0 OR greatest(is_wa, is_tle, is_mle) <> 0) AND item IS NOT NULL
),
{name}_users AS ({users}),
{name} AS (
  SELECT * FROM {name}_c1 WHERE {keep}
    AND NOT (coalesce(item_rating, 0) = 0 AND len(tags) = 0)
)"""


def per_item(src: str, name: str = "per_item") -> str:
    """A-1/A-2/A-3 collapse (all items, rated or not)."""
    return f"""
{name} AS (
  SELECT user_key, item, CAST(max(is_ac) AS INTEGER) AS ever_ac, CAST(sum(is_wa) AS BIGINT) AS wa_count,
         count(*) AS n_attempts, max(item_rating) AS item_rating, any_value(tags) AS tags,
         CAST(1 - min({{'ts': submitted_at, 'id': attempt_id, 'na': 1 - is_ac}}).na AS INTEGER) AS first_is_ac
  FROM {src} GROUP BY user_key, item
)"""


def profiles(src: str = "clean", name: str = "profiles") -> str:
    """A-22 profile derivation joined to the customer ratings."""
    return per_item(src, f"{name}_pi") + f""",
{name}_rt AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_key,
         CASE WHEN c_custkey % 19 <> 3 THEN CAST(900 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 1700 AS INTEGER) ELSE 0 END AS cf_rating,
         CASE WHEN c_custkey % 19 <> 3 THEN CAST(900 + CAST(floor(abs(c_acctbal)) AS INTEGER) % 1700 + c_custkey % 300 AS INTEGER) ELSE 0 END AS cf_max_rating
  FROM customer
),
{name}_pu AS (
  SELECT user_key,
         CAST(count(*) FILTER (WHERE ever_ac = 1) AS BIGINT) AS unique_problems_solved,
         CAST(count(*) AS BIGINT) AS unique_problems_tried,
         avg(first_is_ac) AS first_try_rate,
         coalesce(avg(n_attempts) FILTER (WHERE ever_ac = 1), 0.0) AS avg_attempts_to_ac,
         CAST(count(*) FILTER (WHERE ever_ac = 1 AND item_rating > 0 AND item_rating <= 1000) AS BIGINT) AS solved_lte_1000,
         CAST(count(*) FILTER (WHERE ever_ac = 1 AND item_rating > 1000 AND item_rating <= 1500) AS BIGINT) AS solved_1001_1500,
         CAST(count(*) FILTER (WHERE ever_ac = 1 AND item_rating > 1500 AND item_rating <= 2000) AS BIGINT) AS solved_1501_2000,
         CAST(count(*) FILTER (WHERE ever_ac = 1 AND item_rating > 2000 AND item_rating <= 2500) AS BIGINT) AS solved_2001_2500,
         CAST(count(*) FILTER (WHERE ever_ac = 1 AND item_rating > 2500 AND item_rating <= 3000) AS BIGINT) AS solved_2501_3000,
         CAST(count(*) FILTER (WHERE ever_ac = 1 AND item_rating > 3000) AS BIGINT) AS solved_gt_3000
  FROM {name}_pi GROUP BY user_key
),
{name}_tags AS (
  SELECT user_key, CAST(count(DISTINCT tag) AS BIGINT) AS unique_tags_solved
  FROM (SELECT user_key, unnest(tags) AS tag FROM {name}_pi WHERE ever_ac = 1) GROUP BY user_key
),
{name}_ac AS (SELECT user_key, CAST(sum(is_ac) AS BIGINT) AS total_ac FROM {src} GROUP BY user_key),
{name} AS (
  SELECT pu.*, a.total_ac, coalesce(t.unique_tags_solved, 0) AS unique_tags_solved,
         coalesce(t.unique_tags_solved, 0) * 100.0 / {len(TAGS)} AS tag_coverage_pct,
         r.cf_rating, r.cf_max_rating
  FROM {name}_pu pu JOIN {name}_ac a USING (user_key)
  LEFT JOIN {name}_tags t USING (user_key)
  JOIN {name}_rt r USING (user_key)
)"""


def user_tag(src: str = "clean", prof: str = "profiles", name: str = "user_tag") -> str:
    """E-1: A-4 + J-1 + F-1..F-8."""
    return f"""
{name}_agg AS (
  SELECT user_key, tag, count(*) AS total_attempts, CAST(sum(is_ac) AS BIGINT) AS ac_count,
         CAST(sum(is_wa) AS BIGINT) AS wa_count, avg(item_rating) AS avg_rating_attempted,
         CAST(coalesce(max(item_rating) FILTER (WHERE is_ac = 1), 0) AS DOUBLE) AS max_rating_solved,
         coalesce(avg(item_rating) FILTER (WHERE is_ac = 1), 0.0) AS avg_rating_solved
  FROM (SELECT user_key, item_rating, is_ac, is_wa, unnest(tags) AS tag FROM {src})
  GROUP BY user_key, tag
),
{name}_j AS (
  SELECT a.*, p.cf_rating, p.cf_max_rating, p.first_try_rate, p.avg_attempts_to_ac, p.tag_coverage_pct, p.total_ac
  FROM {name}_agg a LEFT JOIN {prof} p USING (user_key)
),
{name}_c AS (
  SELECT *,
    coalesce((ac_count + 1.0) / (total_attempts + 2.0), 0.0) AS acceptance_rate,
    coalesce(least(greatest(avg_rating_solved / 3500.0, 0.0), 1.0), 0.0) AS difficulty_score,
    coalesce(least(greatest((cf_rating + cf_max_rating) / 7000.0, 0.0), 1.0), 0.0) AS rating_boost,
    coalesce(least(greatest(first_try_rate, 0.0), 1.0), 0.0) AS efficiency_score,
    coalesce(least(greatest(ln(1 + ac_count) / ln(51), 0.0), 1.0), 0.0) AS volume_score,
    coalesce(least(greatest(CASE WHEN total_ac <> 0 THEN ac_count * 1.0 / total_ac END, 0.0), 1.0), 0.0) AS specialization_score
  FROM {name}_j
),
{name} AS (
  SELECT *, least(greatest(0.30 * acceptance_rate + 0.30 * difficulty_score + 0.20 * rating_boost
                + 0.10 * specialization_score + 0.075 * efficiency_score + 0.075 * volume_score, 0.0), 1.0) AS tag_strength
  FROM {name}_c
)"""


def with_(*blocks: str) -> str:
    return "WITH " + ",".join(b.strip().rstrip(",") for b in blocks)


TAG_DIM = "tag_dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {i + 1})" for i, t in enumerate(TAGS)) + ") v(tag, ord))"


def vectors(ut: str = "user_tag", name: str = "vec") -> str:
    """A-9: 82-dim feature-major vector per user."""
    parts = [f"coalesce(max({f}) FILTER (WHERE tag = '{t}'), 0.0)"
             for f in ("acceptance_rate", "difficulty_score", "specialization_score", "volume_score") for t in TAGS]
    parts += ["coalesce(max(rating_boost), 0.0)", "coalesce(max(efficiency_score), 0.0)"]
    return f"{name} AS (SELECT user_key, [{', '.join(parts)}]::DOUBLE[] AS vec FROM {ut} GROUP BY user_key)"


def peers(vec: str = "vec", name: str = "peers", k: int = 50) -> str:
    """E-3 by brute force: all ordered pairs, top k, similarities."""
    return f"""
{name}_pairs AS (
  SELECT a.user_key AS target_key, b.user_key AS peer_key, list_distance(a.vec, b.vec) AS distance
  FROM {vec} a JOIN {vec} b ON a.user_key <> b.user_key
),
{name}_r AS (
  SELECT *, max(distance) OVER (PARTITION BY target_key) AS d_max_all,
         row_number() OVER (PARTITION BY target_key ORDER BY round(distance, 9), peer_key) AS rank
  FROM {name}_pairs
),
{name}_k AS (
  SELECT *, min(distance) OVER (PARTITION BY target_key) AS d_first, max(distance) OVER (PARTITION BY target_key) AS d_last
  FROM {name}_r WHERE rank <= {k}
),
{name} AS (
  SELECT target_key, peer_key, CAST(rank AS INTEGER) AS rank, distance,
         (1.0 - (distance - d_first) / CASE WHEN d_last > d_first THEN d_last - d_first ELSE 1.0 END) * 100.0 AS similarity,
         CASE WHEN d_max_all > 0 THEN greatest(0.0, 1.0 - distance / d_max_all) * 100.0 ELSE 100.0 END AS display_similarity
  FROM {name}_k
)"""


def item_stats(src: str = "clean", name: str = "istats") -> str:
    """A-1 (rated) + A-5 zero-filled."""
    return per_item(src, f"{name}_pi0") + f""",
{name}_pi AS (SELECT * FROM {name}_pi0 WHERE item_rating > 0),
{name}_tag AS (
  SELECT user_key, tag, CAST(count(*) FILTER (WHERE ever_ac = 1) AS BIGINT) AS solved, CAST(count(*) AS BIGINT) AS attempted,
         coalesce(avg(item_rating) FILTER (WHERE ever_ac = 1), 0.0) AS avg_difficulty
  FROM (SELECT user_key, ever_ac, item_rating, unnest(tags) AS tag FROM {name}_pi) GROUP BY user_key, tag
),
{name}_tot AS (SELECT user_key, CAST(sum(ever_ac) AS BIGINT) AS total_solved FROM {name}_pi GROUP BY user_key),
{name} AS (
  SELECT t.user_key, d.tag, d.ord, coalesce(s.solved, 0) AS solved, coalesce(s.attempted, 0) AS attempted,
         coalesce(s.avg_difficulty, 0.0) AS avg_difficulty, t.total_solved
  FROM {name}_tot t CROSS JOIN tag_dim d LEFT JOIN {name}_tag s ON s.user_key = t.user_key AND s.tag = d.tag
)"""


def bench(stats: str = "istats", pr: str = "peers", name: str = "bench") -> str:
    """E-2: A-12 medians + F-9/F-10 + L-3."""
    return f"""
{name}_med AS (
  SELECT p.target_key, s.tag,
         coalesce(median(CAST(s.solved AS DOUBLE)), 0.0) AS peer_median_solved,
         coalesce(median(s.solved * 1.0 / s.attempted) FILTER (WHERE s.attempted > 0), 0.0) AS peer_median_acceptance,
         coalesce(median(s.avg_difficulty) FILTER (WHERE s.solved > 0), 0.0) AS peer_median_difficulty,
         coalesce(median(s.solved * 1.0 / s.total_solved) FILTER (WHERE s.total_solved > 0), 0.0) AS peer_median_specialization
  FROM {pr} p JOIN {stats} s ON s.user_key = p.peer_key GROUP BY p.target_key, s.tag
),
{name}_b AS (
  SELECT s.user_key AS target_key, s.tag, s.ord, s.solved, s.attempted, s.avg_difficulty, s.total_solved,
         coalesce(m.peer_median_solved, 0.0) AS pms, coalesce(m.peer_median_acceptance, 0.0) AS pma,
         coalesce(m.peer_median_difficulty, 0.0) AS pmd, coalesce(m.peer_median_specialization, 0.0) AS pmsp,
         CASE WHEN s.attempted > 0 THEN s.solved * 1.0 / s.attempted ELSE 0.0 END AS ua,
         CASE WHEN s.total_solved > 0 THEN s.solved * 1.0 / s.total_solved ELSE 0.0 END AS us
  FROM {stats} s JOIN (SELECT DISTINCT target_key FROM {pr}) t ON t.target_key = s.user_key
  LEFT JOIN {name}_med m ON m.target_key = s.user_key AND m.tag = s.tag
),
{name}_s AS (
  SELECT *,
    CASE WHEN pma > 0 THEN least(ua / pma, 1.0) WHEN ua > 0 THEN 1.0 ELSE 0.0 END AS acc_score,
    CASE WHEN pmd > 0 AND solved > 0 THEN least(avg_difficulty / pmd, 1.0) WHEN solved > 0 THEN 1.0 ELSE 0.0 END AS diff_score,
    CASE WHEN pmsp > 0 THEN least(us / pmsp, 1.0) WHEN us > 0 THEN 1.0 ELSE 0.0 END AS spec_score,
    CASE WHEN pms > 0 THEN 1.0 - exp(-solved / pms) WHEN solved > 0 THEN 1.0 ELSE 0.0 END AS vol_score
  FROM {name}_b
),
{name} AS (
  SELECT target_key, tag, solved, attempted, avg_difficulty, ua AS acceptance_rate, us AS specialization_score,
         acc_score, diff_score, spec_score, vol_score,
         100.0 * (0.35 * acc_score + 0.35 * diff_score + 0.1 * spec_score + 0.2 * vol_score) AS strength,
         pms AS peer_median_solved, pma AS peer_median_acceptance, pmd AS peer_median_difficulty,
         pmsp AS peer_median_specialization,
         CASE WHEN attempted >= 1 THEN CAST(row_number() OVER (PARTITION BY target_key, attempted >= 1
              ORDER BY 100.0 * (0.35 * acc_score + 0.35 * diff_score + 0.1 * spec_score + 0.2 * vol_score) DESC, ord) AS INTEGER) END AS tag_rank
  FROM {name}_s
)"""


def recommend(src: str = "clean", ut: str = "user_tag", prof: str = "profiles", pr: str = "peers",
              limit: int = 200, top: int = 50) -> str:
    """E-4: pool (A-16/J-5/J-7/L-1), peer strength (A-15), scoring (M-16), attempts (M-19)."""
    return f"""
solved AS (SELECT DISTINCT user_key, item FROM {src} WHERE is_ac = 1),
items AS (SELECT item, max(item_rating) AS item_rating, any_value(tags) AS tags FROM {src} WHERE item_rating > 0 GROUP BY item),
pool0 AS (
  SELECT p.target_key, s.item, sum(p.similarity / 100.0) AS collab_score
  FROM {pr} p JOIN solved s ON s.user_key = p.peer_key
  WHERE NOT EXISTS (SELECT 1 FROM solved t WHERE t.user_key = p.target_key AND t.item = s.item)
  GROUP BY p.target_key, s.item
),
pool AS (
  SELECT * FROM (
    SELECT p.*, i.item_rating, i.tags,
           CAST(row_number() OVER (PARTITION BY p.target_key ORDER BY round(p.collab_score, 9) DESC, p.item) AS INTEGER) AS pool_rank
    FROM pool0 p JOIN items i ON i.item = p.item) WHERE pool_rank <= {limit}
),
ctx AS (
  SELECT p.user_key AS target_key, CASE WHEN p.cf_rating > 0 THEN p.cf_rating ELSE 1200 END AS user_rating
  FROM {prof} p
),
pool_tags AS (SELECT target_key, item, unnest(tags) AS tag FROM pool),
feat AS (
  SELECT pt.target_key, pt.item, avg(coalesce(u.tag_strength, 0.0)) AS mean_ts
  FROM pool_tags pt LEFT JOIN {ut} u ON u.user_key = pt.target_key AND u.tag = pt.tag
  GROUP BY pt.target_key, pt.item
),
pstr0 AS (
  SELECT p.target_key, u.tag, sum(p.display_similarity / 100.0 * u.tag_strength) AS ws, sum(p.display_similarity / 100.0) AS sw
  FROM {pr} p JOIN {ut} u ON u.user_key = p.peer_key GROUP BY p.target_key, u.tag
),
pstr AS (
  SELECT t.target_key, d.tag, CASE WHEN s.sw > 0 THEN s.ws / s.sw ELSE 0.5 END AS peer_strength
  FROM (SELECT DISTINCT target_key FROM {pr}) t CROSS JOIN tag_dim d
  LEFT JOIN pstr0 s ON s.target_key = t.target_key AND s.tag = d.tag
),
boost AS (
  SELECT pt.target_key, pt.item, avg((1.0 - coalesce(u.tag_strength, 0.0)) * coalesce(ps.peer_strength, 0.0)) AS weakness_boost
  FROM pool_tags pt LEFT JOIN {ut} u ON u.user_key = pt.target_key AND u.tag = pt.tag
  LEFT JOIN pstr ps ON ps.target_key = pt.target_key AND ps.tag = pt.tag
  GROUP BY pt.target_key, pt.item
),
scored AS (
  SELECT p.target_key, p.item, p.item_rating, p.collab_score, CAST(p.item_rating - c.user_rating AS DOUBLE) AS rating_diff,
         coalesce(f.mean_ts, 0.0) AS mean_ts,
         least(greatest(0.1 - (p.item_rating - c.user_rating) / 1000.0 + coalesce(f.mean_ts, 0.0), -1.0), 1.0) AS solve_score,
         coalesce(b.weakness_boost, 0.0) AS weakness_boost
  FROM pool p JOIN ctx c ON c.target_key = p.target_key
  LEFT JOIN feat f ON f.target_key = p.target_key AND f.item = p.item
  LEFT JOIN boost b ON b.target_key = p.target_key AND b.item = p.item
),
ranked AS (
  SELECT *, (solve_score + 1.0) / 2.0 AS difficulty_match,
         0.6 * ((solve_score + 1.0) / 2.0) + 0.4 * weakness_boost AS final_score
  FROM scored WHERE solve_score BETWEEN -0.2 AND 0.8
),
recs0 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY target_key ORDER BY round(weakness_boost, 9) DESC, round(final_score, 9) DESC, item) AS INTEGER) AS rec_rank
  FROM ranked
),
recs AS (
  SELECT *,
    CASE WHEN rec_rank <= {top} THEN least(greatest(1.0 + greatest(rating_diff, 0.0) / 400.0 + (1.0 - mean_ts), 1.0), 10.0) END AS estimated_attempts
  FROM recs0
)"""


def impact(ut: str = "user_tag") -> str:
    """M-17 by brute force over the 20 one-tag boosts (needs the recommend blocks)."""
    return f"""
base AS (
  SELECT p.target_key, p.item, p.tags, CAST(p.item_rating - c.user_rating AS DOUBLE) AS rating_diff,
         CASE WHEN least(greatest(0.1 - (p.item_rating - c.user_rating) / 1000.0 + coalesce(f.mean_ts, 0.0), -1.0), 1.0)
              BETWEEN -0.2 AND 0.8 THEN 1 ELSE 0 END AS base_in
  FROM pool p JOIN ctx c ON c.target_key = p.target_key LEFT JOIN feat f ON f.target_key = p.target_key AND f.item = p.item
),
scen AS (
  SELECT b.target_key, b.item, b.rating_diff, b.base_in, d.tag AS boosted_tag, t.tag AS item_tag
  FROM base b CROSS JOIN tag_dim d, unnest(b.tags) AS t(tag)
),
scen_mean AS (
  SELECT s.target_key, s.item, s.boosted_tag, s.rating_diff, s.base_in,
         avg(CASE WHEN s.item_tag = s.boosted_tag THEN least(1.0, coalesce(u.tag_strength, 0.0) + 0.2)
                  ELSE coalesce(u.tag_strength, 0.0) END) AS mean_b
  FROM scen s LEFT JOIN {ut} u ON u.user_key = s.target_key AND u.tag = s.item_tag
  GROUP BY s.target_key, s.item, s.boosted_tag, s.rating_diff, s.base_in
),
cnt AS (
  SELECT target_key, boosted_tag AS tag,
         sum(CASE WHEN least(greatest(0.1 - rating_diff / 1000.0 + mean_b, -1.0), 1.0) BETWEEN -0.2 AND 0.8 THEN 1 ELSE 0 END)
         - sum(base_in) AS raw_delta
  FROM scen_mean GROUP BY target_key, boosted_tag
),
imp0 AS (
  SELECT c.target_key, c.tag, d.ord, coalesce(u.tag_strength, 0.0) AS strength,
         CAST(greatest(c.raw_delta, 0) AS INTEGER) AS delta_problems
  FROM cnt c JOIN tag_dim d ON d.tag = c.tag LEFT JOIN {ut} u ON u.user_key = c.target_key AND u.tag = c.tag
),
imp AS (
  SELECT target_key, tag, strength, delta_problems, CAST(round(delta_problems / 10.0 * 50) AS INTEGER) AS estimated_rating_gain,
         replace(tag, '_', ' ') AS label,
         CAST(row_number() OVER (PARTITION BY target_key ORDER BY delta_problems DESC, round(delta_problems / 10.0 * 50) DESC, ord) AS INTEGER) AS impact_rank
  FROM imp0
)"""


def success_frame(pi: str = "spi", ut: str = "user_tag", prof: str = "profiles") -> str:
    """M-1 frame + closed-form prediction; needs per_item(clean, 'spi')."""
    return f"""
sf_rated AS (SELECT * FROM {pi} WHERE item_rating > 0 AND user_key IN (SELECT user_key FROM {ut})),
sf_tags AS (SELECT user_key, item, unnest(tags) AS tag FROM sf_rated),
sf_feat AS (
  SELECT t.user_key, t.item, avg(coalesce(u.tag_strength, 0.0)) AS mean_ts, min(coalesce(u.tag_strength, 0.0)) AS min_ts,
         max(coalesce(u.tag_strength, 0.0)) AS max_ts, count(*) AS n_tags
  FROM sf_tags t LEFT JOIN {ut} u ON u.user_key = t.user_key AND u.tag = t.tag GROUP BY t.user_key, t.item
),
sf_solved AS (SELECT user_key, count(*) AS num_solved FROM sf_rated WHERE ever_ac = 1 GROUP BY user_key),
sframe AS (
  SELECT r.user_key, r.item, r.item_rating, r.ever_ac, r.wa_count,
         CAST(coalesce(p.cf_rating, 1200) AS DOUBLE) AS cf_rating,
         CAST(r.item_rating - coalesce(p.cf_rating, 1200) AS DOUBLE) AS rating_diff,
         coalesce(f.mean_ts, 0.0) AS mean_tag_strength, coalesce(f.min_ts, 0.0) AS tag_strength_min,
         coalesce(f.max_ts, 0.0) AS tag_strength_max, CAST(coalesce(f.n_tags, 0) AS DOUBLE) AS problem_tag_count,
         CAST(coalesce(s.num_solved, 0) AS DOUBLE) AS num_solved,
         least(greatest(r.ever_ac - r.wa_count * 0.2, -1.0), 1.0) AS solve_score,
         CASE WHEN (('0x' || substr(md5(CAST(r.user_key AS VARCHAR) || '|' || r.item), 1, 8))::BIGINT % 5) < 1
              THEN 'test' ELSE 'train' END AS split
  FROM sf_rated r LEFT JOIN {prof} p ON p.user_key = r.user_key
  LEFT JOIN sf_feat f ON f.user_key = r.user_key AND f.item = r.item
  LEFT JOIN sf_solved s ON s.user_key = r.user_key
),
spred AS (
  SELECT *, least(greatest(0.1 - rating_diff / 1000.0 + mean_tag_strength, -1.0), 1.0) AS pred,
         1.0 + greatest(rating_diff, 0.0) / 400.0 + (1.0 - mean_tag_strength) AS attempts_pred,
         CAST(least(wa_count + 1, 10) AS DOUBLE) AS attempts
  FROM sframe
)"""
