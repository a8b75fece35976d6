"""Approximate nearest neighbours by cosine over shifted Hilbert orderings.

Vectors are projected on a few random orthogonal directions, shifted, and put on a grid; their
place on a Hilbert curve through the grid is a key under which near vectors are often near. Each of
``ORDERINGS`` projections gives another order. Spark deals every ordering out by key ranges of
about ``block_rows`` vectors; a query meets all vectors of its own range and of the two beside it,
so at least the ``block_rows`` before and after it, and the exact cosines of what the orderings
found are merged. Ranges come from a bounded sample of keys; every vector is in every ordering.

Equal vectors are searched once and represented by their smallest ids, so a vector that a third of
the rows share costs as much as any other. Keys end in bits of a hash of the vector: however many
vectors fall into one cell of the grid, ranges stay even.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor do those whose length is not the most frequent one (of equally frequent ones, the
largest). A row that repeats vec_id and vector counts once; a null vec_id takes no part. A query
with fewer than k candidates gets all. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, ship, written

#: Orderings, directions and grid bits of each, bits of the hash that ends a key.
ORDERINGS, DIRECTIONS, BITS, TIE_BITS = 16, 8, 6, 15
#: Rows of a key range: this many times the number of vectors to this power, but no more than one in
#: so many vectors, so that 16 orderings of three ranges meet less than the table, and no fewer than the last.
RANGE_FACTOR, RANGE_POWER, RANGES, LEAST_ROWS = 4.0, 0.6, 50, 64
#: Vectors whose keys place the ranges, at most (about; drawn by a hash of the vector).
SAMPLE = 20_000
QUERY_STEP, NEAREST = 50, 5
#: How far rounding can move a cosine, amply; pairs summed at a time.
ROUNDING, SECTION = 1e-9, 1 << 16
PAIR = "query_group long, group long, score double"


def block_rows(n: int) -> int:
    return max(LEAST_ROWS, min(n // RANGES, math.ceil(RANGE_FACTOR * n**RANGE_POWER)))


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of grid points (n, dimensions), coordinates below 2**bits, on a Hilbert curve.

    Works in bit planes from the top: each plane's orientation follows from the planes above it,
    by exchanging or inverting the lower bits of the first coordinate and the one at hand.
    """
    x = np.ascontiguousarray(grid.T).astype(np.uint64)
    dimensions = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << plane), np.uint64((1 << plane) - 1)
        for i in range(dimensions):
            on = (x[i] & bit) != 0
            exchange = np.where(on, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, exchange)
            if i:
                x[i] ^= exchange
    for i in range(1, dimensions):  # Gray decoding
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        on = (x[-1] & np.uint64(1 << plane)) != 0
        flip = np.where(on, flip ^ np.uint64((1 << plane) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for i in range(dimensions):
            key = key << np.uint64(1) | x[i] >> np.uint64(plane) & np.uint64(1)
    return key


class Orderings:
    """The projections of all orderings for vectors of one length."""

    def __init__(self, length: int, n: int = ORDERINGS, seed: int = 7):
        random = np.random.default_rng(seed)
        self.directions = min(DIRECTIONS, length)
        per_turn = max(1, length // self.directions)
        turns = [np.linalg.qr(random.normal(size=(length, length)))[0] for _ in range(-(-n // per_turn))]
        columns = [(turns[t // per_turn], (t % per_turn) * self.directions) for t in range(n)]
        self.projections = [turn[:, c : c + self.directions] for turn, c in columns]
        self.shifts = random.uniform(0.4, 0.6, size=(n, self.directions))
        # components of a unit vector spread like 1 / sqrt(length)
        self.scale = math.sqrt(length) / 3.6

    def keys(self, vectors: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """(orderings, n) keys below 2**63; ``vectors`` of length one."""
        top = (1 << BITS) - 1
        out = np.empty((len(self.projections), len(vectors)), dtype=np.int64)
        for t, projection in enumerate(self.projections):
            grid = np.clip((vectors @ projection * self.scale + self.shifts[t]) * (top + 1), 0, top).astype(np.int64)
            out[t] = (hilbert(grid, BITS) << np.uint64(TIE_BITS)).astype(np.int64) | (ties & ((1 << TIE_BITS) - 1))
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    vector = F.col("embedding")

    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    present = vector.isNotNull() & F.col("vec_id").isNotNull() & (F.size(vector) > 0)
    rows = embeddings.filter(present & F.forall(vector, good) & F.exists(vector, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.filter(F.size("vector") == (lengths["length"] if lengths else -1))


def best_pairs(units: np.ndarray, groups: np.ndarray, queries: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """(query, row, score) of each query's ``n`` best rows; of equal scores the smaller group wins.

    The product of matrices only tells what can be among them: everything that reaches the n-th
    score, or comes as near as rounding allows, is summed in one fixed order, so that equal vectors
    score equally everywhere.
    """
    parts = []
    for first in range(0, len(queries), 256):
        some = queries[first : first + 256]
        rough = units[some] @ units[rows].T
        least = np.partition(rough, len(rows) - n, axis=1)[:, len(rows) - n]
        q, c = np.nonzero(rough >= least[:, None] - ROUNDING)
        score = np.concatenate(
            [(units[some[q[i : i + SECTION]]] * units[rows[c[i : i + SECTION]]]).sum(axis=1) for i in range(0, len(q), SECTION)]
        )
        order = np.lexsort((groups[rows[c]], -score, q))
        q, c, score = q[order], c[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = place < n
        parts.append((some[q[kept]], rows[c[kept]], score[kept]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _search(k: int):
    def run(key, table):
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        units = _units(_vectors(table.column("vector").combine_chunks()))
        groups = table.column("group").to_numpy()
        queries, rows = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        n = min(k + 1, len(rows))
        found = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
        if n and len(queries):
            q, c, score = best_pairs(units, groups, queries, rows, n)
            found = [groups[q], groups[c], score]
        return pa.table(dict(zip(("query_group", "group", "score"), found, strict=True)))

    return run


def nearest(embeddings: DataFrame, step: int = QUERY_STEP, k: int = NEAREST, range_rows: int | None = None) -> DataFrame:
    """For every row whose vec_id ``step`` divides, its k nearest: query_id, rank, vec_id, score.

    ``range_rows`` replaces the size of a key range. Vectors in clusters are found in ranges of a few
    dozen; the default suits vectors without any structure.
    """
    rows = usable(embeddings).distinct()
    asks = F.col("vec_id") % step == 0
    smallest = Window.partitionBy("vector").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k + 1)
    members = members.groupBy("vector").agg(F.min("vec_id").alias("group"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    asked = rows.groupBy("vector").agg(F.max(asks).alias("asked"))
    groups = written(asked.join(members, "vector"), "ann-groups")
    n = groups.count()
    shape = groups.select(F.size("vector").alias("length")).first()
    orderings = Orderings(shape["length"] if shape else 1)
    blocks = max(1, n // (range_rows or block_rows(n)))
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "vector"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = groups.filter(drawn).select("vector", F.xxhash64("vector").alias("tie")).toArrow()
    if sample.num_rows:
        vectors = _vectors(sample.column("vector").combine_chunks())
        keys = np.sort(orderings.keys(_units(vectors), sample.column("tie").to_numpy()), axis=1)
        cuts = keys[:, [len(keys[0]) * b // blocks for b in range(1, blocks)]]
    else:
        cuts = np.zeros((len(orderings.projections), 0), dtype=np.int64)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, asked = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            keys = orderings.keys(_units(_vectors(vectors)), batch.column(3).to_numpy())
            for t, of_ordering in enumerate(keys):
                block = np.searchsorted(cuts[t], of_ordering, side="right")
                at = np.nonzero(asked)[0]
                asking = [(at[(block[at] + d >= 0) & (block[at] + d <= len(cuts[t]))], d) for d in (-1, 0, 1)]
                index = np.concatenate([np.arange(len(block)), *(x for x, _ in asking)])
                where = np.concatenate([block, *(block[x] + d for x, d in asking)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(index), t), pa.int32()),
                        pa.array(where, pa.int32()),
                        pa.array(np.arange(len(index)) >= len(block), pa.bool_()),
                        batch.column(0).take(pa.array(index)),
                        vectors.take(pa.array(index)),
                    ],
                    names=["ordering", "block", "asks", "group", "vector"],
                )

    kind = dict(groups.dtypes)["vector"]
    keyed = groups.select("group", "vector", "asked", F.xxhash64("vector").alias("tie"))
    dealt = arrow_map(keyed, deal, f"ordering int, block int, asks boolean, group long, vector {kind}")
    ship(embeddings.sparkSession)
    found = dealt.groupBy("ordering", "block").applyInArrow(_search(k), PAIR)
    best = found.groupBy("query_group", "group").agg(F.max("score").alias("score"))
    by_score = Window.partitionBy("query_group").orderBy(F.desc("score"), "group")
    best = best.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k + 1)
    best = best.join(groups.select("group", "members"), "group").select("query_group", "score", F.explode("members").alias("vec_id"))
    queries = rows.filter(asks).select(F.col("vec_id").alias("query_id"), "vector")
    queries = queries.join(groups.select("vector", F.col("group").alias("query_group")), "vector").select("query_id", "query_group")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = queries.join(best, "query_group").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(ranked))
    return pairs.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
