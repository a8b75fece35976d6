"""Connected components of a table of links, by alternating large and small stars.

Every task first replaces the links it reads by stars of the same components, a bounded number at a time, so
that few rounds are left for the stars over the whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, forget, written

#: Links that a reading task gathers before it replaces them.
LINKS_HELD = 1 << 20


def least_reached(ends: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches; ``ends`` has a row (a, b) per link."""
    least = np.arange(n)
    while True:
        a, b = least[ends[:, 0]], least[ends[:, 1]]
        apart = a != b
        if not apart.any():
            return least
        np.minimum.at(least, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(further := least[least], least):
            least = further


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that join what the links u-v join, one per node but the least."""
    nodes, ends = np.unique(np.stack([u, v]), return_inverse=True)
    least = least_reached(ends.reshape(2, -1).T, len(nodes))
    hung = least != np.arange(len(nodes))
    return nodes[hung], nodes[least[hung]]


def _task_stars(batches):
    def drawn(held):
        u, v = stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in (0, 1)])
        size += batch.num_rows
        if size >= LINKS_HELD:
            yield drawn(held)
            held, size = [], 0
    if held:
        yield drawn(held)


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang nodes on the least node of their neighbourhood: neighbours above a node (large), or a
    node and its neighbours below it (small). Links have u above v, and so has what is returned."""
    sides = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root"))
    joined = sides.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("root").alias("v"))
    return joined.select(F.when(F.col("v") == F.col("root"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("root").alias("v"))


def _settled(links: DataFrame) -> bool:
    """Whether different links u-v, u above v, are stars: every node hangs on one other, which hangs on none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.agg(F.coalesce(F.max((F.col("ups") > F.col("least")).cast("int")), F.lit(0)).alias("moving")).first()["moving"] == 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the component's least node) of every node with a link.

    ``links`` has columns u and v; their order, repetitions and loops don't matter. Every round is
    a few aggregations and is written, so nothing grows with the number of rounds, and no task or
    the driver holds a component. Tasks draw stars from written links: once for all that reads the stars, and
    apart from a Python step that makes the links, beside which every task would hold a second worker.
    """

    def drawn(pairs: DataFrame) -> DataFrame:
        links = written(pairs, "links")
        out = written(arrow_map(links, _task_stars, "u long, v long"), "stars")
        forget(links)
        return out

    now = drawn(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v"))
    while not _settled(now):
        after = drawn(_stars(_stars(now, large=True), large=False).distinct())
        forget(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
