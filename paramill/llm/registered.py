"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paramill.llm import (
    decontamination,
    exact_dedup,
    filter_audit,
    html_text,
    jaccard_join,
    language,
    mixing,
    neighbours,
    packing,
    quality,
    token_counts,
    token_files,
    vector_codes,
)
from paramill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(work: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: work(table(spark, sf_dir, "documents"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": _quality,
    "op2_ngram_jaccard_join": _documents(jaccard_join.near_duplicates),
    "op3_language_id": _documents(language.identify),
    "op4_packing": _documents(packing.pack),
    "op5_token_counts": _documents(token_counts.token_counts),
    "op6_nearest_neighbours": lambda spark, sf_dir: neighbours.nearest(table(spark, sf_dir, "embeddings")),
    "op7_html_text": lambda spark, sf_dir: html_text.extract(table(spark, sf_dir, "pages")),
    "op8_source_mixing": _documents(mixing.mix),
    "op9_token_files": _documents(token_files.token_file_digest),
    "op10_exact_dedup": _documents(exact_dedup.duplicates),
    "op11_vector_codes": lambda spark, sf_dir: vector_codes.vector_codes(table(spark, sf_dir, "embeddings")),
    "op12_filter_audit": lambda spark, sf_dir: filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_decontamination": lambda spark, sf_dir: decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": jaccard_join.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
