"""Incremental extraction: new pages -> detail batches and an up-to-date training table.

Not part of the batch feature set; it is the streaming form of extracting and merging.
A document must arrive complete in one batch, since its row is replaced as a whole.

The training table lies in buckets by a hash of the document. A batch reads and writes only the
buckets that its documents fall into, so its cost follows the batch and not the table. A manifest
per batch names the file folder of every bucket; it is written last and makes the batch visible as
a whole. Folders that neither the newest nor the one manifest before it name are deleted, so a
batch that was cut off and runs again still finds what it started from.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paramill.operators.extraction import extract
from paramill.operators.merge import merge_training
from paramill.operators.tables import training_table, with_values
from paramill.session import drop_stage, stage
from paramill.sources.pages import PAGE_SCHEMA

#: Buckets of the training table; fixed when a table is begun.
BUCKETS = 256
_BUCKET = "document_bucket"


def _manifest(folder: str, batch: int) -> str:
    return f"{folder}/manifest/batch={batch:010d}"


def _finished(spark: SparkSession, folder: str, before: int | None = None) -> list[int]:
    """Numbers of the finished batches, ascending, below ``before`` if given."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/batch=*/_SUCCESS")
    found = base.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(base)
    batches = sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in (found or []))
    return [b for b in batches if before is None or b < before]


def buckets_of(spark: SparkSession, folder: str, batch: int) -> dict[int, str]:
    """Folder, below the table's, of every filled bucket after ``batch``."""
    return {int(b): name for b, name in json.loads(spark.read.text(_manifest(folder, batch)).first()[0]).items()}


def _read(spark: SparkSession, folder: str, names: list[str]) -> DataFrame | None:
    if not names:
        return None
    # batches differ in the parameters that they met
    return spark.read.option("mergeSchema", True).parquet(*[f"{folder}/training/{n}" for n in names])


def current_training(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The training table after the latest finished batch (below ``before`` if given)."""
    batches = _finished(spark, folder, before)
    return _read(spark, folder, sorted(buckets_of(spark, folder, batches[-1]).values())) if batches else None


def apply_batch(pages: DataFrame, batch: int, folder: str) -> None:
    """Extract one batch and bring the buckets of its documents up to date.

    Runs again with the same result if it was cut off: a batch only reads earlier manifests and
    overwrites its own files.
    """
    spark = pages.sparkSession
    detail = stage(with_values(extract(pages, keep_copies=False)), "batch")
    detail.write.mode("overwrite").parquet(f"{folder}/detail/batch={batch:010d}")
    new = stage(training_table(detail), "batch-training")
    bucket = F.pmod(F.xxhash64("pdf_name"), F.lit(BUCKETS)).cast("int")
    touched = [r[0] for r in new.select(bucket).distinct().collect()]
    done = _finished(spark, folder, batch)
    before = buckets_of(spark, folder, done[-1]) if done else {}
    existing = _read(spark, folder, sorted(before[b] for b in touched if b in before))
    name = f"batch={batch:010d}"
    merged = merge_training(existing, new).withColumn(_BUCKET, bucket)
    merged.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{folder}/training/{name}")
    after = {**before, **{b: f"{name}/{_BUCKET}={b}" for b in touched}}
    line = spark.createDataFrame([(json.dumps(after),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(_manifest(folder, batch))
    older = buckets_of(spark, folder, done[-2]) if len(done) > 1 else {}
    for gone in sorted(set(older.values()) - set(before.values()) - set(after.values())):
        _delete(spark, f"{folder}/training/{gone}")
    drop_stage(new)
    drop_stage(detail)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def extract_stream(spark: SparkSession, pages_folder: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in the page files that are new since the last run, then stop."""
    pages = spark.readStream.schema(PAGE_SCHEMA).parquet(pages_folder)
    return (
        pages.writeStream.foreachBatch(lambda df, batch: apply_batch(df, batch, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
