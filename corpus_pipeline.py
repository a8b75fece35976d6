"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns a
DataFrame; it is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

All stages take empty tables, repeated rows, nulls in any column and further columns of any name,
which pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paramill.llm import exact_dedup, jaccard_join, language, mixing, packing
from paramill.llm.common import table, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; null and empty texts and texts without a letter go.

    Every row is judged by its own text, also among rows that share a doc_id.
    """
    return language.identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest doc_id stays; of rows that
    share that too, one by its content."""
    return exact_dedup.without_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join the one with the least doc_id stays.

    Rows that share a doc_id are one document; texts without words and rows without a doc_id stay.
    """
    return jaccard_join.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it, which may be never; a null source is a source,
    and texts without words weigh nothing."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; a null or empty text is its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mix),
    ("packing", packed),
]

#: Learnt probabilities and bounded open windows have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
