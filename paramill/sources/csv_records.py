"""CSV files read by many tasks, also where quoted values hold line breaks.

A reader that may not split at line breaks has to take a file whole. Here every split of a file is
scanned once for both cases, that it begins inside a quoted value or outside of one: what it ends in
is then one of four things (outside, inside, the same, the other), and a window over one row per
split composes them. Knowing how it begins, each split cuts its lines into records by itself; only
the one record that lies over a split's end is put together from its pieces.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paramill.session import ship, stage

SPLIT = "file string, start long, from_outside boolean, from_inside boolean, closes boolean"
PIECE = "file string, owner long, start long, whole boolean, header boolean, text string"


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted value is open at the end of a line that begins inside or outside of one.

    A quote opens a value only where the value begins; doubled quotes stand for one.
    """
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


def _scan(sep: str):
    def run(batches):
        for (file, start), own in groupby(_lines(batches), key=lambda r: r[:2]):
            outside, inside, closes = False, True, False
            for _, _, line in own:
                outside, inside = ends_inside(line, outside, sep), ends_inside(line, inside, sep)
                closes = closes or not inside
            row = [[file], [start], [outside], [inside], [closes]]
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SPLIT.split(", ")])

    return run


def _cut(sep: str, at_once: int = 4096):
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = [c.split()[0] for c in PIECE.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        out = []
        for (file, start), own in groupby(_lines(batches), key=lambda r: r[:2]):
            held, first, inside, begun = [], start == 0, None, None
            for _, _, line, starts_inside, owner in own:
                if inside is None:
                    # the end of a record that began in an earlier split
                    inside, begun = starts_inside, owner if starts_inside else None
                held.append(line)
                inside = ends_inside(line, inside, sep)
                if not inside:
                    out.append((file, begun if begun is not None else start, start, begun is None, first and begun is None, "\n".join(held)))
                    held, first, begun = [], False, None
                    if len(out) >= at_once:
                        yield batch(out)
                        out = []
            if held:
                out.append((file, begun if begun is not None else start, start, False, first and begun is None, "\n".join(held)))
        if out:
            yield batch(out)

    return run


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``(file, header, text)``: the records of all files, without empty ones; ``header`` marks the first of a file."""
    ship(spark)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, "value")
    # a line without a quote leaves things as they are: a split of such lines ends in what it begins in
    scanned = lines.where(F.contains("value", F.lit('"'))).mapInArrow(_scan(sep), SPLIT)
    splits = lines.select("file", "start").distinct().join(scanned, ["file", "start"], "left").select(
        "file", "start", F.coalesce("from_outside", F.lit(False)).alias("from_outside"),
        F.coalesce("from_inside", F.lit(True)).alias("from_inside"), F.coalesce("closes", F.lit(False)).alias("closes"),
    )
    # where a split ends whatever it begins in, the flips before it don't matter
    settled = F.col("from_outside") == F.col("from_inside")
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counted = splits.withColumn("flips", F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(upto))
    last = F.last(F.when(settled, F.struct(F.col("from_outside").alias("inside"), "flips")), ignorenulls=True).over(before)
    flips = F.coalesce(F.lag("flips").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    known = counted.withColumn("last", last).withColumn("flips_before", flips)
    odd = (F.col("flips_before") - F.coalesce(F.col("last.flips"), F.lit(0))) % 2 == 1
    known = known.withColumn("inside", F.coalesce(F.col("last.inside"), F.lit(False)) != odd)
    ends = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    opens = ends & (~F.col("inside") | F.col("closes"))
    owner = F.last(F.when(opens, F.col("start")), ignorenulls=True).over(before)
    known = known.select(F.col("file").alias("f"), F.col("start").alias("s"), "inside", owner.alias("owner"))
    # one narrow row per split of the files; a broadcast leaves the lines in their order
    begun = lines.join(F.broadcast(known), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    pieces = begun.select("file", "start", "value", "inside", "owner").mapInArrow(_cut(sep), PIECE)
    parts = F.array_sort(F.collect_list(F.struct("start", "text")))
    over_ends = pieces.where("not whole").groupBy("file", "owner").agg(
        F.bool_or("header").alias("header"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text")
    )
    records = pieces.where("whole").select("file", "header", "text").unionByName(over_ends.select("file", "header", "text"))
    return records.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def read_csv_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns of CSV files with a header, as text. The first file by name names the columns."""
    # the header, the types of columns and the values are readers of their own
    records = stage(csv_records(spark, path, sep), "csv-records")
    head = records.where("header").agg(F.min_by("text", "file").alias("text")).first()["text"]
    if head is None:
        return spark.createDataFrame([], "value string").select()
    given = next(csv.reader(io.StringIO(head.lstrip("﻿")), delimiter=sep))
    lowered = [g.lower() for g in given]
    names = [f"_c{i}" if not g else f"{g}{i}" if lowered.count(g.lower()) > 1 else g for i, g in enumerate(given)]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = records.where("not header").select(F.from_csv("text", schema, options).alias("r"))
    return parsed.select(*[F.col("r").getField(n).alias(n) for n in names])
