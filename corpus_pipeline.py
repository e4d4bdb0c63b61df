"""Corpus pipeline: documents in, token ids out.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of ``documents``.

1. quality_rules: documents that the base rule or the learned decision list rejects go.
2. near_dedup: one document of each group of near duplicates stays (five-word shingles, similarity 0.8).
3. substring_dedup: passages of 13 words or more that an earlier document has are cut out; a document of which nothing is left goes.
4. source_mixing: documents are drawn so that sources, languages and forms come nearer to each other (``mixing.GENTLE``).
5. sentencepiece: each text becomes the ids of a public vocabulary, with a check that they decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerskill.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The learned rules and the segmentation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from peerskill.llm.quality_rules import clean_documents

    return clean_documents(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from peerskill.llm.near_dedup import without_near_duplicates

    return without_near_duplicates(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from peerskill.llm.substring_dedup import substring_dedup as cut

    out = cut(docs, carry=("lang", "source"), unchanged=True)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from peerskill.llm.mixing import sampled_documents

    return sampled_documents(docs).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from peerskill.llm.pieces import encode_decode

    out = encode_decode(docs, carry=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
