"""Product codes of vectors, with the nearest codebook entry found through a GNAT.

Vectors become integers and are cut into parts; every part has a codebook of its own. A GNAT over
a codebook's entries keeps, for each split point and each subtree, the range of distances from the
split point to the subtree's entries. A query's distance to a split point then rules out whole
subtrees: one is left out only if its range, widened for rounding, lies strictly outside the
query's distance plus and minus the best distance so far. What is compared in the end are exact
integer squared distances, ties going to the lower index, so the answer is that of a full search.

Each round is one pass over the rows with the codebooks broadcast (a few thousand numbers); tasks
hand on one row of sums per entry that they used.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, and so
are rows whose vector is not as long as that of the first row by (vec_id, vector), nulls last.
Where the length is no multiple of the parts, part p spans [p*n/8], [(p+1)*n/8]. Fewer than 16
rows give as many entries. Repeated rows and vec_ids are rows of their own. Components of 32768
and more in magnitude could overflow the sums of squares and raise ``ValueError``. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import arrow_map, forget, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers below this keep sums of squares within 64 bits.
LARGEST = 1 << 27
#: Split points of a node.
DEGREE = 4


class Gnat:
    """Exact nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries))) if len(entries) else None

    def _squared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a[:, None, :] - b[None, :, :]
        return (d * d).sum(axis=2)

    def _node(self, members: np.ndarray) -> dict:
        """Split points far from each other; every other entry lies in the nearest one's subtree."""
        points = self.entries[members]
        splits = [0]
        near = self._squared(points, points[:1])[:, 0]
        while len(splits) < min(DEGREE, len(members)):
            open_ = np.setdiff1d(np.arange(len(members)), splits)
            splits.append(int(open_[np.argmax(near[open_])]))
            near = np.minimum(near, self._squared(points, points[splits[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(members)), splits)
        to = self._squared(points[splits], points[rest])
        home = to.argmin(axis=0) if len(rest) else np.zeros(0, dtype=int)
        children = []
        for j in range(len(splits)):
            own = np.flatnonzero(home == j)
            if not len(own):
                continue
            distances = np.sqrt(to[:, own].astype(np.float64))
            low, high = np.nextafter(distances.min(axis=1), -np.inf), np.nextafter(distances.max(axis=1), np.inf)
            children.append((j, low, high, self._node(members[rest[own]])))
        return {"splits": members[splits], "points": self.entries[members[splits]], "children": children}

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance, distances computed) per query."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        who = np.full(len(queries), len(self.entries))
        computed = 0

        def visit(node: dict, rows: np.ndarray) -> None:
            nonlocal computed
            squared = self._squared(queries[rows], node["points"])
            computed += squared.size
            for i, entry in enumerate(node["splits"]):
                own = squared[:, i]
                better = (own < best[rows]) | ((own == best[rows]) & (entry < who[rows]))
                best[rows[better]], who[rows[better]] = own[better], entry
            distance = np.sqrt(squared.astype(np.float64))
            below, above = np.nextafter(distance, -np.inf), np.nextafter(distance, np.inf)
            for _, low, high, child in node["children"]:
                radius = np.nextafter(np.sqrt(best[rows].astype(np.float64)), np.inf)
                gap = np.maximum(below - high, low - above).max(axis=1)
                left = np.nextafter(gap, -np.inf) <= radius
                if left.any():
                    visit(child, rows[left])

        if len(queries) and self.root:
            visit(self.root, np.arange(len(queries)))
        return who, best, computed


def bounds(length: int) -> list[int]:
    return [p * length // PARTS for p in range(PARTS + 1)]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), v: the kept rows as whole numbers, written once."""
    component = F.col("embedding").cast("array<double>")
    infinite = F.lit(float("inf"))
    good = component.isNotNull() & F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    largest = F.coalesce(F.array_max(F.transform("e", lambda x: F.abs(x))), F.lit(0.0))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), component.alias("e"), good.alias("good"))
    kept = kept.filter(F.coalesce(F.col("good"), F.lit(False)))
    # too large ones are marked by a null, which the check after this finds
    whole = F.when(largest * SCALE < LARGEST, F.transform("e", lambda x: F.floor(x * SCALE).cast("int")))
    rows = written(kept.select("vec_id", "label", whole.alias("v")), "vector-integers")
    if not rows.filter("v IS NULL").isEmpty():
        raise ValueError(f"components must be below {LARGEST // SCALE} in magnitude")
    return rows


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), length)


def _sums(books: list[np.ndarray], length: int):
    """Assign the rows of a task; one row of sums per used entry."""
    cuts = bounds(length)

    def run(batches):
        trees = [Gnat(b) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            v = _matrix(batch.column(0), length)
            for p, tree in enumerate(trees):
                part = v[:, cuts[p] : cuts[p + 1]]
                who, _, _ = tree.nearest(part)
                counts[p] += np.bincount(who, minlength=len(tree.entries))
                np.add.at(sums[p], who, part)
        used = [(p, e) for p in range(PARTS) for e in np.flatnonzero(counts[p])]
        if used:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in used], pa.int32()),
                    pa.array([int(e) for _, e in used], pa.int32()),
                    pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                    pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64())),
                ],
                names=["part", "entry", "n", "sums"],
            )

    return run


def _averaged(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round; at most 128 rows reach the driver."""
    partial = arrow_map(rows.select("v"), _sums(books, length), "part int, entry int, n long, sums array<long>")
    width = max(b.shape[1] for b in books)
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    following = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():
        book = following[r["part"]]
        book[r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(book.shape[1])]
    return following


def train(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """(codebook per part, vector length) of a table from :func:`integers`."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    if not first:
        return [np.zeros((0, 0), dtype=np.int64)] * PARTS, 0
    length = len(first[0]["v"])
    start = np.array([r["v"] for r in first if len(r["v"]) == length], dtype=np.int64)
    same = rows.filter(F.size("v") == length)
    if len(start) < ENTRIES:  # other lengths stood among the first rows
        start = np.array([r["v"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()], dtype=np.int64)
    cuts = bounds(length)
    books = [start[:, cuts[p] : cuts[p + 1]].copy() for p in range(PARTS)]
    for _ in range(rounds):
        books = _averaged(same, books, length)
    return books, length


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """vec_id, label, code, error of the rows of the codebooks' length."""
    cuts = bounds(length)
    digits = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            v = _matrix(batch.column(2), length)
            codes, error = np.full(len(v), "", dtype="U16"), np.zeros(len(v), dtype=np.int64)
            for p, tree in enumerate(trees):
                who, squared, _ = tree.nearest(v[:, cuts[p] : cuts[p + 1]])
                codes, error = np.char.add(codes, digits[who]), error + squared
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return arrow_map(rows.filter(F.size("v") == length), run, "vec_id long, label string, code string, error long")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    rows = integers(vectors)
    books, length = train(rows)
    coded = written(encode(rows, books, length), "vector-codes")
    forget(rows)
    per_label = coded.groupBy(F.col("label").alias("name")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(per_label, F.col("label").eqNullSafe(F.col("name")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out one after the other."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pts AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // 8) AS p, (i - 1) % (len(v) // 8) AS j, v[i] AS x
  FROM kept, range(1, 65) t(i) WHERE i <= len(v)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT p, e, j, x FROM pts JOIN firsts USING (vec_id))"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 16 + e) AS k FROM (
    SELECT vec_id, q.p, e, sum((q.x - b.x) * (q.x - b.x))::BIGINT AS d
    FROM pts q JOIN b{r} b ON q.p = b.p AND q.j = b.j GROUP BY ALL) GROUP BY ALL)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS x
  FROM b{r} b LEFT JOIN (
    SELECT q.p, k % 16 AS e, j, sum(x)::BIGINT AS s, count(*) AS n
    FROM pts q JOIN a{r} a ON q.vec_id = a.vec_id AND q.p = a.p GROUP BY ALL) m
  ON b.p = m.p AND b.e = m.e AND b.j = m.j)"""
            )
    last = f"a{ROUNDS}"
    return (
        "WITH "
        + ",\n".join(parts)
        + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (k % 16)::INT), '' ORDER BY p) AS code, sum(k // 16)::BIGINT AS error
  FROM {last} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
    )


ORACLE = _oracle()
