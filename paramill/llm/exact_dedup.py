"""Exact duplicates by an extendible-hash index on shared files.

Every text gets a 64-bit key. A directory of key ranges starts with one bucket and doubles:
buckets with more distinct keys than ``capacity`` split on their next bit, until none is
overfull (copies share one key and therefore never make a bucket overfull). Each bucket then
has one owner task, which walks its keys in order, chains different texts that share a key by
comparing their bytes, and writes one entry per different text to the index files. Copies are
collapsed in the reading tasks before anything is shuffled, so a hot text costs its owner one
entry per reading batch.

Defined cases: null text counts as empty; texts are equal if identical after lower-casing A-Z;
of rows with equal text the largest doc_id stays, a null doc_id counts as smallest, and of rows
that also share the doc_id exactly one stays. Empty tables give empty results. Further columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, forget, lower_ascii, unfolded, whole_row, whole_text, written

CAPACITY = 1 << 20
#: Bytes of text that a reading task holds before it passes its collapsed entries on.
HELD_BYTES = 32 << 20
ENTRY = "bucket long, key long, text binary, copies long, top_id long"
INDEX = "bucket long, key long, chain int, keep_id long, group_size long, text_sha256 string"


def directory(keys: DataFrame, capacity: int = CAPACITY) -> np.ndarray:
    """Lower bounds of the buckets' key ranges, ascending.

    Only counts of overfull buckets travel: every round counts the halves of the buckets that
    overflowed in the round before. The directory has about two entries per ``capacity``
    different keys.
    """
    distinct = keys.select("key").distinct()
    starts, open_, depth = [], [(-(1 << 63), distinct.count())], 0
    while open_:
        overfull = [start for start, n in open_ if n > capacity and depth < 63]
        starts += [start for start, n in open_ if n <= capacity or depth >= 63]
        if not overfull:
            break
        depth += 1
        prefix = F.shiftright("key", 64 - depth)
        wanted = keys.sparkSession.createDataFrame([(start >> (64 - depth + 1),) for start in overfull], "parent long")
        counted = (
            distinct.withColumn("prefix", prefix)
            .withColumn("parent", F.shiftright("prefix", 1))
            .join(F.broadcast(wanted), "parent", "left_semi")
            .groupBy("prefix")
            .count()
        )
        n = {r["prefix"]: r["count"] for r in counted.toLocalIterator()}
        halves = [(start >> (64 - depth)) + bit for start in overfull for bit in (0, 1)]
        open_ = [(half << (64 - depth), n.get(half, 0)) for half in halves]
    return np.array(sorted(starts), dtype=np.int64)


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


def _collapse(starts: np.ndarray):
    """Reading side: one entry per different text of what a task holds at a time."""

    def flush(held: dict) -> pa.RecordBatch:
        keys = np.array([k for k, _ in held], dtype=np.int64)
        buckets = np.searchsorted(starts, keys, side="right") - 1
        columns = [
            pa.array(buckets, pa.int64()),
            pa.array(keys, pa.int64()),
            pa.array([t for _, t in held], pa.binary()),
            pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([top for _, top in held.values()], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "text", "copies", "top_id"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for doc_id, key, text in zip(*columns, strict=True):
                old = held.get((key, text))
                if old is None:
                    held[key, text] = (1, doc_id)
                    size += len(text) + 200
                else:
                    held[key, text] = (old[0] + 1, _larger(old[1], doc_id))
                if size > HELD_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _own(batches):
    """Owner side: entries come in key order; a key's different texts form its chain."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    names = [x.split()[0] for x in INDEX.split(", ")]

    def closed(key, bucket, chain):
        for place, (text, (copies, top)) in enumerate(chain.items()):
            yield bucket, key, place, top, copies, hashlib.sha256(text).hexdigest()

    def emit(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    key = bucket = None
    chain: dict[bytes, tuple] = {}
    out = []
    for batch in batches:
        for b, k, text, copies, top in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if k != key:
                out += closed(key, bucket, chain)
                key, bucket, chain = k, b, {}
            old = chain.get(text)
            chain[text] = (copies, top) if old is None else (old[0] + copies, _larger(old[1], top))
        if len(out) > 10_000:
            yield emit(out)
            out = []
    out += closed(key, bucket, chain)
    if out:
        yield emit(out)


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index files: bucket, key, chain (place among texts that share the key), keep_id,
    group_size, text_sha256; one row per different text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(whole_text()).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    keys = written(keyed.select("key"), "dedup-keys")
    starts = directory(keys, capacity)
    forget(keys)
    entries = arrow_map(keyed, _collapse(starts), ENTRY)
    # a bucket's owner; buckets wider than a 1024th of the key space have an owner per such range
    owned = entries.repartition(F.col("bucket"), F.shiftright("key", 54)).sortWithinPartitions("key")
    return written(arrow_map(owned, _own, INDEX), "dedup-index")


def duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, capacity)
    same = Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(lower_ascii(whole_text()).cast("binary"), 256).alias("text_sha256"),
    ).withColumn("copy", F.row_number().over(same))
    return rows.join(index.select("text_sha256", "keep_id", "group_size"), "text_sha256").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of equal texts (null is empty) the row with the largest doc_id; of rows that share that as well,
    the one with the least hash of its content. Rows travel as one struct, whatever their columns
    are called.
    """
    stays = duplicates(docs, capacity).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    rows = docs.select(
        whole_row(docs).alias("row"), F.sha2(lower_ascii(whole_text()).cast("binary"), 256).alias("sha"), F.col("doc_id").cast("long").alias("id")
    )
    same = (F.col("sha") == F.col("kept_sha")) & F.col("id").eqNullSafe(F.col("kept_id"))
    one = rows.join(stays, same, "left_semi").groupBy("sha", "id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return unfolded(one, docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
"""
