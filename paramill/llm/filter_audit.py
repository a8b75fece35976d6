"""How five document filters interact, for every order of applying them.

Which filters a document fails is a mask of five bits, so the corpus comes down to a few cells
(part, mask, good, toxic) with a count each. Every cell folds itself across the literal array of
all 120 orders: an inner fold walks an order with the state "still kept", and gives one struct per
order and step, 600 in all, weighted by the cell's count. The cells of a part, at most 128, are
then summed element by element.

Duplicates never gather a text's copies: rows are counted per (text, part, flags, doc_id) before
anything is joined, and the least doc_id per text is an aggregate that combines before its shuffle.

Defined cases: null text counts as empty; a null doc_id is neither smaller nor larger than another,
so such a row never fails E and never makes another fail it; rows that share a doc_id are separate
documents and don't fail E because of each other; null ``lang`` and empty ``lang`` are one part; a
document counts as good or toxic if any label of its doc_id says so. Without documents there is no
part and no row. Further columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramill.llm.common import WORD, whole_text

FILTERS = "ABCDE"
ORDERS = list(itertools.permutations(range(len(FILTERS))))
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, MARKS = 100, 80, 10, "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != "")
    # one look at the words for both of their filters
    measured = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    bits = F.transform(
        F.array(measured),
        lambda m: F.when(m["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * m["d"] < DISTINCT_SHARE * m["n"], 2).otherwise(0),
    )[0]
    return (
        bits
        + F.when(100 * capitals > CAPITAL_SHARE * F.length(text), 4).otherwise(0)
        + F.when(F.regexp_like(text, F.lit(MARKS)), 8).otherwise(0)
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: the documents by the filters they fail."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        whole_text().alias("text"),
    )
    hashed = rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), text_mask(F.col("text")).alias("mask"))
    counted = hashed.groupBy("sha", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = hashed.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    repeated = first.filter("copies > 1").select("sha", "first_id")
    marked = counted.join(repeated, "sha", "left").withColumn(
        "mask", F.col("mask") + F.when(F.col("doc_id") > F.col("first_id"), 16).otherwise(0)
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    flagged = marked.join(marks.filter("doc_id IS NOT NULL"), "doc_id", "left")
    flags = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return flagged.select("part", "mask", *flags, "n").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _folded() -> Column:
    """The 600 structs of a cell, orders outside and steps inside."""
    mask, n = F.col("mask"), F.col("n")
    none = F.lit(0).cast("long")

    def walk(order: Column) -> Column:
        def step(state: Column, filter_: Column) -> Column:
            fails = F.getbit(mask, filter_) == 1
            removed = state["kept"] & fails
            out = F.struct(
                filter_.alias("filter"),
                F.when(state["kept"] & ~fails, n).otherwise(none).alias("kept"),
                F.when(removed, n).otherwise(none).alias("removed"),
                F.when(~state["kept"] & fails, n).otherwise(none).alias("redundant"),
                F.when(mask == F.call_function("shiftleft", F.lit(1), filter_), n).otherwise(none).alias("unique_fails"),
                F.when(removed, n * F.col("good")).otherwise(none).alias("good_lost"),
                F.when(removed, n * F.col("toxic")).otherwise(none).alias("toxic_lost"),
            )
            return F.struct((state["kept"] & ~fails).alias("kept"), F.concat(state["steps"], F.array(out)).alias("steps"))

        kinds = "filter:int," + ",".join(f"{c}:bigint" for c in COUNTS)
        empty = F.struct(F.lit(True).alias("kept"), F.array().cast(f"array<struct<{kinds}>>").alias("steps"))
        return F.aggregate(order, empty, step, lambda state: state["steps"])

    orders = F.array(*[F.array(*[F.lit(f) for f in order]) for order in ORDERS])
    return F.flatten(F.transform(orders, walk))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the counts in ``COUNTS``, and ``shapley``: what the
    step's filter removes, summed over all orders."""
    folded = cells(docs, labels).repartition("part").select("part", F.posexplode(_folded()).alias("place", "c"))
    sums = folded.groupBy("part", "place", F.col("c.filter").alias("filter")).agg(*[F.sum(f"c.{c}").alias(c) for c in COUNTS])
    shapley = sums.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    letters = F.array(*[F.lit("".join(FILTERS[f] for f in order)) for order in ORDERS])
    steps = len(FILTERS)
    return sums.join(shapley, ["part", "filter"]).select(
        "part",
        F.get(letters, F.floor(F.col("place") / steps).cast("int")).alias("filter_order"),
        (F.col("place") % steps + 1).alias("step"),
        *COUNTS,
        "shapley",
    )


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents),
masks AS (
  SELECT doc_id, part,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM masks LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters AS (SELECT range AS f FROM range(5)),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT o, s.range AS step, o[s.range] AS f,
         list_sum(list_transform(o[1:s.range - 1], lambda x: 1 << x))::BIGINT AS earlier
  FROM orders, range(1, 6) s),
found AS (
  SELECT part, o, step, f, n, good, toxic, mask,
         (mask >> f) & 1 = 1 AS fails, mask & coalesce(earlier, 0) = 0 AS before
  FROM cells, steps),
sums AS (
  SELECT part, o, step, f, coalesce(sum(n) FILTER (before AND NOT fails), 0) AS kept,
         coalesce(sum(n) FILTER (before AND fails), 0) AS removed,
         coalesce(sum(n) FILTER (NOT before AND fails), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = 1 << f), 0) AS unique_fails,
         coalesce(sum(n * good) FILTER (before AND fails), 0) AS good_lost,
         coalesce(sum(n * toxic) FILTER (before AND fails), 0) AS toxic_lost
  FROM found GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda x: chr((65 + x)::INT)), 'string_agg', '') AS filter_order, step::INT AS step,
       kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""
