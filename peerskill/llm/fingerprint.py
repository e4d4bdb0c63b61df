"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch holds every distinct shingle hash below a fixed fraction of the hash range, so sketches of any two texts are comparable
whatever their lengths, the sketch of a union is the union of the sketches, and |A and B| / |A| estimates containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Words of a shingle; share of the hash range that is retained.
SHINGLE, FRACTION = 5, 0.25
_RANGE = 1 << 32
_BLANK = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for none."""
    bare = F.btrim(text, F.lit(_BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingle_hashes(ws: Column, k: int = SHINGLE) -> Column:
    """32-bit hashes (as long) of the runs of ``k`` words; of fewer words, of the whole sequence; none for no words."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - k, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(ws, i + 1, k)), 32))
    return F.when(F.size(ws) > 0, each).otherwise(F.array().cast("array<bigint>"))


def retained(hashes: Column, low: Column) -> Column:
    """Sorted distinct hashes of ``low``, those below the threshold; if there is none, the least hash, so that only texts without words
    have an empty sketch."""
    own = F.when(F.size(low) > 0, low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)
    return F.sort_array(F.array_distinct(own))


def with_sketch(df: DataFrame, text: str, name: str, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Adds the sketch of column ``text`` as ``name`` (array<bigint>).  Each step is a column of its own, so that it runs once."""
    return (
        df.withColumn("_w", words(F.col(text))).withColumn("_h", shingle_hashes(F.col("_w"), k)).drop("_w")
        .withColumn("_low", F.filter("_h", lambda h: h < int(fraction * _RANGE)))
        .withColumn(name, retained(F.col("_h"), F.col("_low"))).drop("_h", "_low")
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has: 1 for equal sketches, else 0 if one is empty."""
    return (
        F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    )


def merged(sketches: DataFrame, by: str, sketch: str = "sketch") -> DataFrame:
    """Elements of the sketch of the union of the texts of each ``by``: (by, hash), one row per hash, so no group is held in one row."""
    return sketches.select(by, F.explode(sketch).alias("hash")).distinct()


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def _block(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` below ``key``: a binary tree of comparisons."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def with_next(df: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """Adds next_<c> of ``columns``: of the row with the next smaller doc_id (after the last: of the first).

    Blocks of doc_id, bounded by quantiles that are ids of the table, are ordered in a task each; the first row of a block is also
    sent to the block that it follows.  Equal ids are ordered by the hash of their text.  Rows without doc_id have no next row
    (null) and are spread over blocks of their own."""
    cuts = [i / blocks for i in range(1, blocks)] + [1.0]
    row = df.select(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), F.lit(100 * blocks)).alias("q"), F.max("doc_id").alias("top")).first()
    top = row["top"]
    bounds = sorted({x for x in row["q"] or [] if x < top})
    key, place = F.col("doc_id"), _block(F.col("doc_id"), bounds)
    hashed = F.xxhash64("text")
    ends = [F.when(key == top, F.lit(0))] if top is not None else []  # the first row of all follows the last
    if bounds:
        ends.append(F.when(key.isin(bounds) if len(bounds) < 10 else F.array_contains(F.lit(bounds), key), place + 1))
    own = F.when(key.isNull(), F.lit(-1) - F.pmod(hashed, F.lit(blocks)).cast("int")).otherwise(place)
    sent = F.filter(F.array(F.struct(F.lit(0).alias("copy"), own.cast("int").alias("block")), *(F.struct(F.lit(1).alias("copy"), e.cast("int").alias("block")) for e in ends)), lambda x: x["block"].isNotNull())
    spread = df.withColumn("_hash", hashed).withColumn("_sent", F.explode(sent))
    spread = spread.withColumns({"_copy": F.col("_sent.copy"), "_block": F.col("_sent.block")}).drop("_sent")
    order = "partition by _block order by _copy, doc_id desc, _hash"
    nexts = [F.expr(f"case when doc_id is not null then lead({c}) over ({order}) end").alias(f"next_{c}") for c in columns]
    return spread.select("*", *nexts).where("_copy = 0").drop("_copy", "_block", "_hash")


def fingerprints(docs: DataFrame, k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``docs``.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's, in descending order of doc_id.  Likeness is the estimated containment of the document's shingles in the other text.
    Null texts are empty; empty texts have an empty fingerprint and likeness 1 to others without words, else 0.  A row without doc_id
    has no next document: its edited text is what is left, near_next is 0.  Repeated ids are ordered by text; repeated rows are equal."""
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    own = with_sketch(texts(docs), "text", "sketch", k, fraction)
    both = with_next(own, ["text", "sketch"], blocks).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(coalesce(next_text, ''), cast(n_chars div 2 as int)))"))
    both = with_sketch(both.drop("text", "next_text"), "edited", "edited_sketch", k, fraction)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        F.coalesce(containment(F.col("sketch"), F.col("next_sketch")), F.lit(0.0)).alias("near_next"),
    )
