"""Registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .boosted import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op8_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), k AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM s
), f AS (
  SELECT win, min(doc_id) AS d FROM k GROUP BY win HAVING min(doc_id) < max(doc_id)
), h AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT k.doc_id, k.i FROM k JOIN f USING (win) WHERE f.d < k.doc_id)
), g AS (
  SELECT doc_id, list(p) AS ps FROM h GROUP BY doc_id
), z AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)) AS kept
  FROM w LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM z
"""


@register
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")


@register
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..session import scratch_path
    from .warc import read_warc, write_warc

    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op5_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT sha, min(page_id) AS first_id FROM p GROUP BY sha
), b AS (
  SELECT p.*, first_id,
         array_to_string(list_transform(range(1, 41),
           lambda i: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
             strpos('0123456789abcdef', sha[i:i]))), '') AS bits
  FROM p JOIN f USING (sha)
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    16 * CAST(bits[5*j+1:5*j+1] AS INT) + 8 * CAST(bits[5*j+2:5*j+2] AS INT) + 4 * CAST(bits[5*j+3:5*j+3] AS INT)
    + 2 * CAST(bits[5*j+4:5*j+4] AS INT) + CAST(bits[5*j+5:5*j+5] AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b
"""


@register
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


@register
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


SQL["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r(x, y) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), g AS (
  SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN g USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@register
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"))


@register
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


@register
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


@register
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [
    len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o
), r AS (
  SELECT part, o, step, o[step] AS flt, n, good, toxic, fails[o[step]] AS fail,
         len(list_filter(o[1:step-1], lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda v: v)) AS n_fails
  FROM c, s
), g AS (
  SELECT part, o, step, any_value(flt) AS flt,
    sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (NOT gone AND fail) AS removed, sum(n) FILTER (gone AND fail) AS redundant,
    sum(n) FILTER (fail AND n_fails = 1) AS unique_fails, sum(good) FILTER (NOT gone AND fail) AS good_lost, sum(toxic) FILTER (NOT gone AND fail) AS toxic_lost
  FROM r GROUP BY part, o, step
)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, flt) AS BIGINT) AS shapley
FROM g
"""


@register
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


@register
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


#: The table of crc32 and a step a byte; ``_crc(x)`` is the unsigned crc32 of the text x beside ``crc_table``.
_CRC_TABLE = r"""
z(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS remainders FROM z WHERE k = 8)"""


def _crc(x: str) -> str:
    each = f"list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {each}), lambda c, b: xor(remainders[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _level(i: int) -> str:
    """One level of the tree, by window sums: the rows of w{i} with the nodes of the next level as w{i + 1}."""
    return f""", a{i} AS (
  SELECT *, max(r0) OVER p - min(r0) OVER p AS x0, max(r1) OVER p - min(r1) OVER p AS x1, max(r2) OVER p - min(r2) OVER p AS x2,
         (leaves // 2) * sum(size) OVER p AS goal FROM w{i} WINDOW p AS (PARTITION BY node)
), b{i} AS (
  SELECT *, CASE WHEN x0 >= x1 AND x0 >= x2 THEN r0 WHEN x1 >= x2 THEN r1 ELSE r2 END AS place FROM a{i}
), c{i} AS (
  SELECT *, leaves * sum(size) OVER (PARTITION BY node ORDER BY place) AS upto FROM b{i}
), e{i} AS (
  SELECT *, min(CASE WHEN upto >= goal THEN place END) OVER (PARTITION BY node) AS f FROM c{i}
), s{i} AS (
  SELECT *, leaves > 1 AND (place > f OR (place = f AND upto - goal > goal - (upto - leaves * size))) AS higher FROM e{i}
), w{i + 1} AS (
  SELECT doc_id, size, crc, r0, r1, r2, CASE WHEN higher THEN node + leaves // 2 ELSE node END AS node,
         CASE WHEN leaves = 1 THEN 1 WHEN higher THEN leaves - leaves // 2 ELSE leaves // 2 END AS leaves FROM s{i}
)"""


SQL["op12_sharding"] = f"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), k AS (
  SELECT doc_id, n + 8 AS size, {_crc('t')} AS crc, n AS d0, 1000 * n // greatest(length(t), 1) AS d1,
         1000 * length(t) // (length(t) - length(replace(t, ' ', '')) + 1) AS d2 FROM d, crc_table
), w0 AS (
  SELECT doc_id, size, crc, row_number() OVER (ORDER BY d0, crc, doc_id) AS r0, row_number() OVER (ORDER BY d1, crc, doc_id) AS r1,
         row_number() OVER (ORDER BY d2, crc, doc_id) AS r2, 0 AS node, 24 AS leaves FROM k
){"".join(map(_level, range(5)))}
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY node ORDER BY doc_id, crc) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM w5
"""

SQL["op13_spelling_variants"] = f"""
WITH RECURSIVE {_CRC_TABLE}, r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), q AS (
  SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run
), h AS (
  SELECT run, n, {_crc("concat(doc_id, ':', run)")} AS h FROM q, crc_table
), m AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM h
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.short
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.short
), b AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 5 * v.n THEN b.m END AS form_n,
         CASE WHEN b.m >= 5 * v.n THEN (SELECT min(p.other) FROM p WHERE p.word = v.word AND p.m = b.m) END AS form
  FROM v LEFT JOIN b ON b.word = v.word
), t(word, root, deep) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT t.word, f.form, deep + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL
), u AS (
  SELECT word, arg_max(root, deep) AS root FROM t GROUP BY word
)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM f JOIN u ON u.word = f.word
"""
