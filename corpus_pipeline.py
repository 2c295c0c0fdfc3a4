"""Training-data pipeline: five stages over ``documents``, each written and read again.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. The first four give
documents with the columns they got; the last gives the packed pieces. Stages judge
what their predecessor kept and learn from that alone, apart from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import language_id, quality_llr, secret_scan, simhash_cover, vector_packing
from meterline.llm.common import cut, ship, table, where_text

#: Documents whose language is less certain than this are rejected.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows: those without a letter, with null text
    or with a less certain prediction go."""
    ship(spark)
    return where_text(docs, language_id.certain(spark, language_id.fit(docs), MIN_LANGUAGE_SCORE))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are no less like the trusted ones."""
    ship(spark)
    return where_text(docs, quality_llr.keeper(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the smallest id."""
    ship(spark)
    return simhash_cover.survivors(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind in brackets; n_chars follows."""
    ship(spark)
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    ship(spark)
    return vector_packing.pack(vector_packing.pieces(docs))


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The stages' models and decoders are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
