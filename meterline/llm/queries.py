"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from meterline.llm import (
    binary_packing,
    byte_bpe,
    language_id,
    license_scan,
    prefix_hash,
    quality_llr,
    secret_scan,
    simhash_cover,
    spelling_variants,
    url_rules,
    vector_packing,
    warc,
    word_runs,
)
from meterline.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


_ALL: dict[str, Query] = {
    "op1_prefix_fingerprints": prefix_hash.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_warc": warc.query,
    "op4_url_filter": url_rules.query,
    "op5_quality_rules": quality_llr.query,
    "op6_best_fit_packing": vector_packing.query,
    "op7_license_scan": license_scan.query,
    "op8_language_id": language_id.query,
    "op9_secret_scan": secret_scan.query,
    "op10_simhash_near_dedup": simhash_cover.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_power_packing": binary_packing.query,
    "op13_word_runs": word_runs.query,
    "pipeline": corpus_pipeline.run,
}
QUERIES: dict[str, Query] = {name: _shipped(query) for name, query in _ALL.items()}
SQL: dict[str, str] = {
    "op3_warc": warc.SQL,
}
