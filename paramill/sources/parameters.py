"""Parameter sets as JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramill.operators.audit import _c


def load_parameters(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One design per JSON file: the named fields as raw text, absent ones null."""
    files = spark.read.text(path, wholetext=True)
    values = F.from_json("value", "map<string,string>")
    parsed = files.select(F.col("_metadata.file_name").alias("file"), values.alias("p"))
    return parsed.select("file", *[F.try_element_at("p", F.lit(n)).alias(n) for n in names])


def save_parameters(designs: DataFrame, path: str) -> None:
    """One JSON object per design; null fields are written."""
    designs.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def designs_long(df: DataFrame, key: str) -> DataFrame:
    """Wide designs -> ``(key, name, value)`` with raw text values."""
    names = [c for c in df.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), _c(n).cast("string").alias("value")) for n in names])
    return df.select(_c(key), F.inline(pairs))
