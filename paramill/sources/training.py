"""Training tables and the five output tables, read and written."""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramill import vocabulary as v
from paramill.functions.scoring import with_numbers
from paramill.operators.audit import _c
from paramill.session import ship
from paramill.sources.csv_records import read_csv_text
from paramill.sources.pages import path_exists

# --- fixed values: texts that mean a missing value --------------------------------------
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_training_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header, read by as many tasks as it has splits. Missing texts become null.

    A column is numeric if every present value is a number, which one aggregate over all
    columns settles; give ``schema`` to skip that scan.
    """
    raw = read_csv_text(spark, path)
    text = raw.select(*[F.when(~_c(c).isin(MISSING_TEXTS), _c(c)).alias(c) for c in raw.columns])
    if schema is not None:
        fields = spark.createDataFrame([], schema).schema.fields
        return text.select(*[_c(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
    if not text.columns:
        return text
    read = {c: f"_read_{i}" for i, c in enumerate(text.columns)}
    both = with_numbers(text, {n: _c(c) for c, n in read.items()})
    bad = both.agg(*[F.count_if(_c(c).isNotNull() & F.col(n).isNull()).alias(n) for c, n in read.items()]).first()
    return both.select(*[F.col(n).alias(c) if bad[n] == 0 else _c(c) for c, n in read.items()])


def read_existing_training(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame | None:
    """An earlier training table to merge into; None with a warning if there is none.

    A first column with one of a few usual names is taken for the document name.
    """
    if not path_exists(spark, path):
        warnings.warn(f"nothing to merge with at {path}", stacklevel=2)
        return None
    df = read_training_csv(spark, path) if file_format == "csv" else spark.read.format(file_format).load(path)
    return name_source(df)


def name_source(df: DataFrame) -> DataFrame:
    if "pdf_name" not in df.columns and df.columns and df.columns[0].lower() in v.FIRST_COLUMN_NAMES:
        return df.withColumnRenamed(df.columns[0], "pdf_name")
    return df


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_training_csv(training: DataFrame, path: str) -> None:
    training.write.mode("overwrite").option("header", True).csv(path)


#: Files up to this many bytes are hashed as one value; larger ones are read by pieces of the second size.
WHOLE_FILE, PIECE = 64 << 20, 1 << 20


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below ``path``, of any size: ``(path, bytes, sha256)``.

    A large file is never one value: its task opens it by the file system of its path (a local or
    mounted folder, HDFS, S3, GCS) and holds one piece at a time. Small files come from any store
    that Spark reads. Sizes are known before contents, so no file is read twice.
    Empty files have no row: Spark's file scan passes over them.
    """
    files = spark.read.format("binaryFile").load(path)
    kind = "path string, bytes long, sha256 string"
    small = files.where(F.col("length") <= WHOLE_FILE)
    small = small.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > WHOLE_FILE).select("path", F.col("length").alias("bytes"))
    ship(spark)
    return small.unionByName(large.mapInArrow(_digests, kind))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the files a task was given, one after the other."""
    for batch in batches:
        found = [_digest(path) for path in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])


def _digest(path: str) -> str:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        store, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        # the path column has names as they are, a URI has them escaped
        scheme = "s3" if scheme in ("s3a", "s3n") else scheme
        store, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    digest = hashlib.sha256()
    with store.open_input_stream(name, buffer_size=0) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


#: Column of :func:`in_file_order`.
FILE_ORDER = "file_order"


def in_file_order(scan: DataFrame) -> DataFrame:
    """A plain file scan with ``file_order``, which sorts its rows as the files have them: by file,
    then by the place within it. Parquet tells a row's number; in other files it is the split's
    start and the order within the split."""
    where = [F.col("_metadata.file_path").alias("file")]
    try:
        return scan.select("*", F.struct(*where, F.col("_metadata.row_index").alias("row")).alias(FILE_ORDER))
    except AnalysisException:
        place = [F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")]
        return scan.select("*", F.struct(*where, *place).alias(FILE_ORDER))
