"""Detail records -> summary, training, review and quality tables."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramill import vocabulary as v
from paramill.operators.extraction import DETAIL_COLUMNS

def training_columns() -> list[str]:
    """Every column a training table can have: closed, so pivoting needs no discovery job."""
    names = []
    for parameter in v.NUMERIC_PARAMETERS:
        if v.PARAMETER_CATEGORY[parameter] == v.WATER_QUALITY:
            names += [f"{parameter}__{role}" for role in v.ROLES]
        else:
            names.append(parameter)
    return sorted(names)


def with_values(detail: DataFrame) -> DataFrame:
    """Records without parameter or value dropped."""
    return detail.dropna(subset=[c for c in ("parameter", "value") if c in detail.columns])


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition, dropped by a generator: a filter would be pushed into the extraction
    below and compute there whatever it names once more."""
    one = F.explode(F.when(condition, F.array(F.lit(0))))
    return df.select(*df.columns, one.alias("_kept")).drop("_kept")


def clean_detail(detail: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact copies once, records without parameter or value dropped.

    Records that were numbered without their copies need no more than :func:`with_values`.

    A table that needs few columns names them: what identifies a record is kept beside them,
    and nothing else is compared or shuffled.
    """
    identity = ["record_id"] if "record_id" in detail.columns else ["pdf_name", "page", "mention"]
    if columns is not None:
        detail = detail.select(*dict.fromkeys([*identity, *columns]))
    present = [F.col(c).isNotNull() for c in ("parameter", "value") if c in detail.columns]
    present += [~F.isnan("value")] if "value" in detail.columns else []
    return (kept(detail, functools.reduce(operator.and_, present)) if present else detail).distinct()


def is_accepted() -> Column:
    return F.coalesce(F.col("quality_status") == v.ACCEPTED, F.lit(False))


def is_ambiguous() -> Column:
    """Water quality value that names neither influent nor effluent nor removal."""
    return F.coalesce(
        (F.col("category") == v.WATER_QUALITY) & (F.col("water_role") == v.ROLE_UNSPECIFIED), F.lit(False)
    )


def summary(detail: DataFrame) -> DataFrame:
    """Records per document, status, category, parameter and unit, in key order."""
    keys = ["pdf_name", "quality_status", "category", "parameter", "unit"]
    return detail.groupBy(*keys).agg(F.count("*").alias(v.SUMMARY_COUNT)).orderBy(*keys)


def quality_report(detail: DataFrame) -> DataFrame:
    """Records per status and reason."""
    return (
        detail.groupBy("quality_status", "quality_reason")
        .agg(F.count("*").alias(v.QUALITY_COUNT))
        .orderBy(F.asc("quality_status"), F.desc(v.QUALITY_COUNT))
    )


def review_table(detail: DataFrame) -> DataFrame:
    """Records a person has to look at."""
    return kept(detail, ~is_accepted() | is_ambiguous())


def with_training_parameter(detail: DataFrame) -> DataFrame:
    """Add the training column a record belongs to; null if it is not fit for training."""
    name = F.when(
        F.col("category") == v.WATER_QUALITY, F.concat_ws("__", "parameter", "water_role")
    ).otherwise(F.col("parameter"))
    return detail.withColumn("training_parameter", F.when(is_accepted() & ~is_ambiguous(), name))


def training_table(detail: DataFrame, columns: list[str] | None = None, drop_empty: bool = True) -> DataFrame:
    """One row per document, one column per parameter, mean of the values.

    ``columns`` fixes the layout; by default every possible column is computed in one pass
    and those without any value are dropped, which is settled by a one-row aggregate. With
    ``drop_empty=False`` the layout is complete and nothing runs.

    Unfit records are left out of the means instead of filtered away first: a filter would
    be pushed into the extraction below and score every record twice. Documents that have
    no value at all are dropped at the end.
    """
    names = columns or training_columns()
    named = with_training_parameter(detail)
    wide = (
        named.select("pdf_name", "training_parameter", "value")
        .groupBy("pdf_name")
        .pivot("training_parameter", names)
        .agg(F.avg("value"))
    )
    if columns is None and drop_empty:
        # at most one row per known column
        seen = named.groupBy("training_parameter").count().collect()
        present = {row["training_parameter"] for row in seen}
        names = [n for n in names if n in present]
        wide = wide.select("pdf_name", *names)
    filled = F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull() if names else F.lit(False)
    return wide.where(filled)


def build_tables(detail: DataFrame) -> dict[str, DataFrame]:
    """The five output tables of a cleaned detail; stage it first, each table reads it."""
    return {
        "detail": detail.select(*DETAIL_COLUMNS),
        "summary": summary(detail),
        "training": training_table(detail),
        "review": review_table(detail).select(*DETAIL_COLUMNS),
        "quality": quality_report(detail),
    }


def run_counts(detail: DataFrame, training: DataFrame) -> DataFrame:
    """One row: detail, accepted, review and training rows."""
    review = (~is_accepted() | is_ambiguous()).cast("int")
    detail_part = detail.agg(
        F.count("*").alias("detail_rows"), F.coalesce(F.sum(review), F.lit(0)).alias("review_rows")
    ).select("detail_rows", "review_rows", F.lit(0).cast("bigint").alias("training_rows"))
    training_part = training.agg(F.count("*").alias("training_rows")).select(
        F.lit(0).cast("bigint").alias("detail_rows"), F.lit(0).cast("bigint").alias("review_rows"), "training_rows"
    )
    return (
        detail_part.unionByName(training_part)
        .agg(*[F.sum(c).alias(c) for c in ("detail_rows", "review_rows", "training_rows")])
        .select(
            "detail_rows",
            (F.col("detail_rows") - F.col("review_rows")).alias("accepted_rows"),
            "review_rows",
            "training_rows",
        )
    )
