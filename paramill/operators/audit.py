"""Quality audit of a training table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramill import vocabulary as v


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark would compare it as the largest number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.nanvl(_c(c), F.lit(None).cast("double")) for c in floats}) if floats else df


def _c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def find_source_column(columns: list[str], preferred: str | None = None) -> str | None:
    """The column that names the source of a row; an explicit one must exist."""
    if preferred:
        if preferred not in columns:
            raise ValueError(f"no column {preferred} to tell sources by")
        return preferred
    return next((c for c in v.SOURCE_COLUMNS if c in columns), None)


def missing_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form ``(column, missing_ratio)`` of the numeric columns, in one pass."""
    columns = numeric_columns(df) if columns is None else columns
    wide = nan_to_null(df).agg(*[F.avg(_c(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _c(c).alias("missing_ratio")) for c in columns])
    return wide.select(F.inline(pairs))


def constant_flags(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which columns hold at most one distinct value: smallest equals largest, or none at all."""
    if not columns:
        return {}
    aggs = [
        F.coalesce(F.min(_c(c)) == F.max(_c(c)), F.lit(True)).alias(str(i)) for i, c in enumerate(columns)
    ]
    row = nan_to_null(df).agg(*aggs).first()
    return {c: row[i] for i, c in enumerate(columns)}


def row_fingerprint(df: DataFrame) -> Column:
    """SHA-256 of a row's content; rows that grouping takes for equal have equal ones.

    Every value is written with its length before it, so different rows are different texts. Equal
    texts are as certain as the hash: no two different ones with equal hashes are known.
    """
    parts = []
    for f in df.schema.fields:
        x = _c(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = (x + F.lit(0.0)).cast("string")  # one zero
        elif isinstance(f.dataType, T.TimestampType):
            text = F.unix_micros(x).cast("string")
        elif isinstance(f.dataType, T.BinaryType):
            text = F.hex(x)
        elif isinstance(f.dataType, (T.StructType, T.ArrayType)):
            text = F.to_json(F.struct(x))
        else:
            text = x.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(F.lit(""), *parts), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows that repeat an earlier row (nulls equal).

    Only fingerprints of 32 bytes are shuffled, whatever the width of the rows, and frequent rows
    are counted before.
    """
    df = nan_to_null(df)
    copies = df.select(row_fingerprint(df).alias("row")).groupBy("row").count()
    return copies.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def audit(df: DataFrame, source_column: str | None = None) -> DataFrame:
    """The audit report as one row.

    All statistics are one aggregate without a shuffle of rows; the duplicates are counted by
    fingerprints of the rows.
    """
    repeated = duplicate_rows(df).first()["duplicate_rows"]
    df = nan_to_null(df)
    numeric = numeric_columns(df)
    source = find_source_column(df.columns, source_column)
    position = {c: i for i, c in enumerate(df.columns)}
    aggs = [
        F.count("*").alias("rows"),
        F.lit(repeated).cast("bigint").alias("duplicate_rows"),
        (F.countDistinct(_c(source)) if source else F.lit(0).cast("bigint")).alias("source_count"),
    ]
    for c in df.columns:
        aggs.append(F.count_if(_c(c).isNull()).alias(f"m{position[c]}"))
    for c in numeric:
        aggs.append(F.coalesce(F.min(_c(c)) == F.max(_c(c)), F.lit(True)).alias(f"k{position[c]}"))
    stats = df.agg(*aggs)

    def names(columns: list[str], test) -> Column:
        picked = [F.when(test(position[c]), F.lit(c)) for c in columns]
        return F.filter(F.array(*picked, F.lit(None).cast("string")), lambda x: x.isNotNull())

    stats = stats.withColumn("constant", names(numeric, lambda i: F.col(f"k{i}"))).withColumn(
        "empty", names(df.columns, lambda i: F.col(f"m{i}") == F.col("rows"))
    )
    if source is None:
        source_warning = F.lit(v.WARN_NO_SOURCE)
    else:
        source_warning = F.when(F.col("source_count") < 3, v.WARN_FEW_SOURCES)
    head, tail = v.WARN_DUPLICATES
    warnings = [
        F.when(F.col("rows") < 30, v.WARN_FEW_ROWS),
        source_warning,
        F.when(
            F.col("duplicate_rows") > 0,
            F.concat(F.lit(head), F.col("duplicate_rows").cast("string"), F.lit(tail)),
        ),
        F.when(
            F.size("constant") > 0, F.concat(F.lit(v.WARN_CONSTANT), F.array_join("constant", ", "))
        ),
    ]
    ratio = [
        x
        for c in numeric
        for x in (F.lit(c), F.try_divide(F.col(f"m{position[c]}").cast("double"), F.col("rows").cast("double")))
    ]
    ratios = F.create_map(*ratio) if ratio else F.create_map().cast("map<string,double>")
    return stats.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric)).alias("numeric_columns"),
        F.lit(source).cast("string").alias("source_column"),
        "source_count",
        "duplicate_rows",
        F.col("empty").alias("all_missing_columns"),
        F.col("constant").alias("constant_numeric_columns"),
        ratios.alias("missing_ratio"),
        F.filter(F.array(*warnings), lambda w: w.isNotNull()).alias("warnings"),
    )
