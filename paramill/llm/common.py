"""Helpers that several operators share: column rules, Arrow maps, tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paramill.llm.chunk_ids import begin
from paramill.session import shared_folder, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space between words: space and the five control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes whose values a Python worker holds as objects at a time (one row may be longer).
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 16 << 20
#: Bytes of rows that Spark hands to Python at a time, unless the session says.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
HANDED_BYTES = 4 << 20

_folders: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of theirs can clash with a helper's."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def unfolded(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a :func:`whole_row` called ``row``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def held_out(modulus: int, remainder: int) -> Column:
    """True for rows that are never learnt from: crc32 of the id's text has that remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` that hands on at most ``ROWS_AT_ONCE`` rows and ``BYTES_AT_ONCE`` at a time, to ``work``
    and back to Spark, which holds a whole batch outside its heap."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def sliced(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield from halved(batch.slice(first, ROWS_AT_ONCE))

    def halved(batch):
        if batch.num_rows < 2 or batch.nbytes <= BYTES_AT_ONCE:
            yield batch
            return
        middle = batch.num_rows // 2
        yield from halved(batch.slice(0, middle))
        yield from halved(batch.slice(middle))

    step = f"{work.__module__}.{work.__qualname__}"

    def run(batches):
        begin(step)
        yield from sliced(work(sliced(batches)))
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Bound what a task hands to Python at a time by bytes, where the session leaves that to Spark: the default
    holds 10,000 rows of any length outside the heap, twice while a buffer grows. No result depends on it."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(HANDED_BYTES))


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; it is deleted when Python ends."""
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders[path] = spark
        atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if the session still runs."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table once to the shared folder and go on from the files.

    It cuts the lineage: what reads it survives lost executors by reading again. ``options`` are those of
    Parquet files.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    files = df.inputFiles()
    if files and "/llm-" in files[0]:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])
