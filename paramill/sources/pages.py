"""Page text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "pdf_name string, page int, text string"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def pages_from_text(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Text files of a folder, one document each; form feeds part the pages, counted from 1.

    It is an error if the folder or matching files are missing.
    """
    if not path_exists(spark, folder):
        raise FileNotFoundError(f"no folder {folder}")
    if not path_exists(spark, f"{folder}/{pattern}"):
        raise FileNotFoundError(f"nothing in {folder} is called {pattern}")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    pages = files.select(
        F.col("_metadata.file_name").alias("pdf_name"), F.posexplode(F.split("value", "\f", -1)).alias("n", "text")
    )
    return pages.select("pdf_name", (F.col("n") + 1).alias("page"), "text")


def pages_from_table(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """A stored page table with the columns ``pdf_name, page, text``."""
    return spark.read.format(file_format).schema(PAGE_SCHEMA).load(path)
