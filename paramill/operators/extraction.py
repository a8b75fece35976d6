"""Page text -> detail records.

``pages`` has the columns ``pdf_name, page, text``; a (pdf_name, page) pair names one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramill import vocabulary as v
from paramill.functions import scoring, text
from paramill.session import stage

DETAIL_COLUMNS = [
    "record_id", "pdf_name", "page", "water_role", "review_status", "quality_status", "confidence",
    "quality_reason", "category", "parameter", "matched_alias", "value", "unit", "raw_value",
    "raw_unit", "context",
]

# all that is known about a numeric spelling / a unit, so that one lookup serves a record
_ALIAS_FACTS = {
    a: {"parameter": q, "category": v.PARAMETER_CATEGORY[q], "expected": v.EXPECTED_GROUP[q]}
    for a, q in v.ALIAS_PARAMETER.items()
    if q in v.EXPECTED_GROUP
}
_UNIT_FACTS = {
    u: {
        "unit_group": v.UNIT_GROUP.get(u),
        "factor": v.UNIT_CONVERSION[u][0] if u in v.UNIT_CONVERSION else 1.0,
        "unit_name": v.UNIT_CONVERSION[u][1] if u in v.UNIT_CONVERSION else None,
    }
    for u in v.UNIT_GROUP
}

# pages numbered together: bounds the windows of number_records in pages
PAGE_BLOCK_BITS = 12


def _with_pieces(pages: DataFrame) -> DataFrame:
    """Pages cut at their mentions; those without a digit have no pieces and hence no rows in a generator.

    A filter would be pushed below whatever deals the pages to tasks and run there for all of them.
    """
    return pages.withColumn("pieces", F.when(F.col("text").rlike(r"(?U)\d"), text.mention_pieces(F.col("text"))))


def scan_mentions(pages: DataFrame) -> DataFrame:
    """Every number(+unit) mention: one row per mention with the text around it.

    Narrow: reads a page, emits its mentions, no shuffle. ``mention`` counts from 0 in a page.
    """
    found = _with_pieces(pages)
    rows = found.select(
        "pdf_name", "page", F.posexplode(text.mention_windows(F.col("pieces"))).alias("mention", "w")
    )
    return (
        rows.select("pdf_name", "page", "mention", "w.hit", "w.before", "w.after")
        .withColumn("raw_value", text.mention_value(F.col("hit")))
        .withColumn("raw_unit", text.mention_unit(F.col("hit"), F.col("raw_value")))
    )


def mention_offsets(pages: DataFrame) -> DataFrame:
    """Start and end of every mention within its page."""
    found = _with_pieces(pages)
    return found.select(
        "pdf_name", "page", F.posexplode(text.mention_offsets(F.col("pieces"))).alias("mention", "o")
    ).select("pdf_name", "page", "mention", "o.start", "o.end")


def match_records(pages: DataFrame) -> DataFrame:
    """Detail records without their running number; ``mention`` orders them within a page.

    One narrow stage from scan to record.
    """
    rows = (
        scan_mentions(pages)
        .withColumn("before", F.translate("before", "\n", " "))
        .withColumn("rest", F.translate(F.concat("hit", "after"), "\n", " "))
        .withColumn("parsed", scoring.parse_value(F.col("raw_value")))
    )
    rows = text.with_nearest_alias(rows, "before", "rest", keep=F.col("parsed").isNotNull())
    rows = rows.select(
        "pdf_name",
        "page",
        "mention",
        "raw_value",
        "raw_unit",
        "parsed",
        F.concat("before", "rest").alias("context"),
        F.length("before").alias("value_pos"),
        "matched_alias",
        "keyword_pos",
        text.lookup_row(_ALIAS_FACTS, F.col("matched_alias")).alias("fact"),
        text.lookup_row(_UNIT_FACTS, F.lower("raw_unit")).alias("unit_fact"),
    )
    is_water = F.col("fact.category") == v.WATER_QUALITY
    sentence, at = text.sentence_around(F.col("context"), F.col("keyword_pos"))
    score, reason = scoring.score_and_reason(
        F.col("fact.parameter"),
        F.col("parsed"),
        F.col("raw_unit"),
        F.abs(F.col("keyword_pos") - F.col("value_pos")),
        F.col("fact.expected"),
        F.col("unit_fact.unit_group"),
    )
    rows = rows.withColumn("confidence", score).withColumn("quality_reason", reason)
    # plain columns, not a struct: struct fields would be inlined into every use
    rows = rows.withColumn("sentence", F.when(is_water, sentence)).withColumn("at", F.when(is_water, at))
    role = text.role_in_sentence(F.col("sentence"), F.col("at"))
    factor = F.coalesce(F.col("unit_fact.factor"), F.lit(1.0))
    return rows.select(
        "pdf_name",
        "page",
        "mention",
        F.when(is_water, F.coalesce(role, F.lit(v.ROLE_UNSPECIFIED)))
        .otherwise(v.ROLE_NOT_APPLICABLE)
        .alias("water_role"),
        F.lit(v.PENDING).alias("review_status"),
        scoring.status_of(F.col("confidence")).alias("quality_status"),
        "confidence",
        "quality_reason",
        "fact.category",
        "fact.parameter",
        "matched_alias",
        (F.col("parsed") * factor).alias("value"),
        F.coalesce("unit_fact.unit_name", "raw_unit").alias("unit"),
        "raw_value",
        "raw_unit",
        "context",
    )


def number_records(records: DataFrame, keep_copies: bool = True) -> DataFrame:
    """Add ``record_id``: a running number per document over pages and mentions. Exact copies share
    theirs, or come once without ``keep_copies``.

    A document may hold a large share of all records, so its records are never gathered in one
    task. They are dealt once by (document, block of pages); copies drop out and records are
    numbered within that partitioning, and the numbered records are written. A second look at three
    narrow columns gives the records before each block, which the blocks then add. Pages may be any
    whole numbers.

    Defined cases: records without a document or page come first in theirs and have an empty name
    or page in their id; different records of the same page and mention are numbered in the order
    of their content.
    """
    keys = ["pdf_name", "page_block"]
    rest = [c for c in records.columns if c not in ("pdf_name", "page", "mention")]
    inside = Window.partitionBy(*keys).orderBy("page", "mention", *rest)
    dealt = records.withColumn("page_block", F.shiftright(F.col("page").cast("bigint"), PAGE_BLOCK_BITS)).repartition(*keys)
    once = dealt if keep_copies else dealt.distinct()
    numbered = stage(once.withColumn("n_in_block", F.dense_rank().over(inside)), "records")
    ahead = Window.partitionBy("pdf_name").orderBy("page_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        numbered.groupBy(*keys)
        .agg(F.max("n_in_block").alias("n"))
        .select(
            F.col("pdf_name").alias("doc"), F.col("page_block").alias("block"),
            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before_block"),
        )
    )
    record_id = F.concat(
        F.coalesce("pdf_name", F.lit("")), F.lit(":p"), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(":"),
        (F.col("before_block") + F.col("n_in_block")).cast("string"),
    )
    same = F.col("pdf_name").eqNullSafe(F.col("doc")) & F.col("page_block").eqNullSafe(F.col("block"))
    # left, so that none can be lost
    return numbered.join(before, same, "left").withColumn("record_id", record_id).select(*DETAIL_COLUMNS)


def extract(pages: DataFrame, keep_copies: bool = True) -> DataFrame:
    """Numbered detail records of all pages."""
    return number_records(match_records(pages), keep_copies)
