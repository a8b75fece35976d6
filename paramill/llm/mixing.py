"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate, the number of times the mix takes it on average. Among all rates
between 0 and 2 whose taken words meet each source's target, entropy balancing picks those that
stay closest to 1 in entropy; the solution is an exponential tilt of the document's size,
``2 / (1 + exp(-lambda * size))``, with one multiplier per source. The multipliers solve the
convex dual by safeguarded Newton steps, all sources at once: an iteration is one aggregation over
the table of (source, size, documents).

Rates become copies by running sums along each source's documents in order of size: a document
takes another copy when the running sum of rates passes the next whole number. Neighbours in that
order have like sizes, so a source's taken words miss its target by at most about its largest
document; the rest is then settled by single copies, largest fitting sizes first. Documents of one size are interchangeable, which keeps all windows small: sizes of a
source, hash blocks of a size, documents of a block.

Defined cases: null text has size 0; a null source is a source of its own, last in order; a
source without words has target 0; repeated rows are rows of their own; a null doc_id is kept.
Empty tables give empty results. Further columns are ignored. Reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paramill.llm.common import WORD, forget, unfolded, whole_row, written

#: Weights of sources in code point order, repeating; share of all words that the mix takes;
#: most times a document, and so a source, is taken.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Newton iterations at most, and the residual, as a share of the source, at which they end.
ITERATIONS, ENOUGH = 200, 1e-6
#: Hash blocks among the documents of one source and size.
BLOCKS = 4096


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target of each source from (source, source_size): shares by weight, none above ``most``
    times its size. Windows over one row per source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = (F.row_number().over(ordered) - 1) % len(weights) + 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    weighed = weighed.withColumn("level", F.col("cap") / F.col("weight"))
    # the sum of targets grows with the level of water; sources are full in order of their level
    filled = Window.orderBy("level")
    wanted = F.lit(share) * F.sum("source_size").over(every)
    weight_left = F.sum("weight").over(every) - F.sum("weight").over(filled)
    poured = F.sum("cap").over(filled) + F.col("level") * weight_left
    full = weighed.withColumn("wanted", wanted).withColumn("full", poured <= wanted)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    water = F.coalesce((F.col("wanted") - used) / open_weight, F.lit(0.0))
    return full.withColumn("water", water).select(
        "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target")
    )


def _rate(multiplier: Column, size: Column, full: Column) -> Column:
    return F.when(full, F.lit(float(MOST))).otherwise(MOST / (1 + F.exp(-multiplier * size)))


def _same_source(left: DataFrame, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"])


def multipliers(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """Solve the dual: source, source_size, target, full, multiplier."""
    spread = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("size") * F.col("n").cast("double")).alias("squares"))
    joined = wanted.join(spread.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # multipliers are stepped in units of one over the typical size
    state = written(
        joined.select(
            "source", "source_size", "target",
            (F.col("target") >= F.col("source_size") * F.lit(float(MOST)) * (1 - 1e-12)).alias("full"),
            F.coalesce(F.try_divide(F.col("squares"), F.col("source_size")), F.lit(1.0)).alias("unit"),
            F.lit(0.0).alias("multiplier"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"),
            F.lit(1.0).alias("residual"),
        ),
        "mix-state",
    )
    for _ in range(ITERATIONS):
        now = state.withColumnRenamed("source", "_s")
        rows = histogram.join(now, histogram["source"].eqNullSafe(F.col("_s"))).drop("_s")
        tilt = 1 / (1 + F.exp(-F.col("multiplier") * F.col("size")))
        words = F.col("n") * F.col("size")
        sums = rows.groupBy("source").agg(
            F.sum(words * tilt * MOST).alias("taken"),
            F.sum(words * F.col("size") * tilt * (1 - tilt) * MOST).alias("slope"),
        )
        stepped = state.join(sums.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        over = F.col("taken") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("multiplier")), F.when(over, F.col("multiplier")).otherwise(F.col("high"))
        reach = (1 + F.abs(F.col("multiplier") * F.col("unit"))) / F.col("unit")
        newton = F.col("multiplier") - F.greatest(-reach, F.least(reach, F.coalesce(F.try_divide(F.col("taken") - F.col("target"), F.col("slope")), F.lit(0.0))))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        residual = F.abs(F.col("taken") - F.col("target")) / F.greatest(F.col("source_size"), F.lit(1))
        done = F.col("full") | (F.col("source_size") == 0) | (residual <= ENOUGH)
        stepped = stepped.withColumn("low", low).withColumn("high", high).withColumn("residual", F.when(done, F.lit(0.0)).otherwise(residual))
        stepped = stepped.withColumn("multiplier", F.when(done, F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        before, state = state, written(stepped.drop("taken", "slope"), "mix-state")
        worst = state.agg(F.max("residual")).first()[0]
        forget(before)
        if not worst:
            break
    return state.select("source", "source_size", "target", "full", "multiplier")


def settled(rated: DataFrame) -> DataFrame:
    """Add or take single copies, largest sizes that still fit first, until a source's words are
    as near its target as that gets. One array of a source's different sizes is walked."""
    missing = F.round(F.first("target") - F.sum(F.col("given") * F.col("size"))).cast("long")
    entry = F.struct("size", (MOST * F.col("n") - F.col("given")).alias("free"), F.col("given").alias("used"))
    per = rated.filter("size > 0").groupBy("source").agg(missing.alias("missing"), F.sort_array(F.collect_list(entry), asc=False).alias("sizes"))

    def step(state: Column, x: Column) -> Column:
        room = F.when(F.col("missing") > 0, x["free"]).otherwise(x["used"])
        moves = F.least(room, F.floor(state["left"] / x["size"]))
        more = F.concat(state["moves"], F.array(F.struct(x["size"].alias("size"), moves.alias("moves"))))
        after = F.struct((state["left"] - moves * x["size"]).alias("left"), more.alias("moves"))
        return F.when((state["left"] >= x["size"]) & (room > 0), after).otherwise(state)

    start = F.struct(F.abs("missing").alias("left"), F.expr("cast(array() AS array<struct<size: bigint, moves: bigint>>)").alias("moves"))
    walked = per.select("source", F.signum("missing").cast("long").alias("sign"), F.aggregate("sizes", start, step)["moves"].alias("moves"))
    moves = walked.select(F.col("source").alias("_s"), "sign", F.inline("moves").alias("_size", "moves"))
    joined = rated.join(moves, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")), "left")
    return joined.withColumn("given", F.col("given") + F.coalesce(F.col("sign") * F.col("moves"), F.lit(0))).drop("_s", "_size", "sign", "moves")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source."""
    base = written(sized(docs), "mix-sizes")
    histogram = written(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = multipliers(histogram, targets(sources)).withColumnRenamed("source", "_s")
    by_size = Window.partitionBy("source").orderBy("size")
    rated = histogram.join(solved, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rated = rated.withColumn("rates", F.col("n") * _rate(F.col("multiplier"), F.col("size"), F.col("full")))
    run = F.sum("rates").over(by_size)
    rated = rated.withColumn("given", F.floor(run + 0.5) - F.floor(run - F.col("rates") + 0.5))
    rated = rated.withColumn("given", F.greatest(F.lit(0), F.least(F.col("given"), MOST * F.col("n"))).cast("long"))
    rated = settled(written(rated.select("source", "size", "n", "source_size", "target", "given"), "mix-rounded"))
    plan = rated.select(
        F.col("source").alias("_s"), F.col("size").alias("_size"), "source_size", "target",
        F.floor(F.col("given") / F.col("n")).cast("long").alias("each"), (F.col("given") % F.col("n")).alias("extra"),
    )
    blocked = base.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)))
    of_size = Window.partitionBy("source", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("source", "size", "block").agg(F.count("*").alias("in_block"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("in_block").over(of_size), F.lit(0)))
    first = blocks.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")))
    first = first.select("_s", "_size", F.col("block").alias("_block"), "before", "source_size", "target", "each", "extra")
    in_block = Window.partitionBy("source", "size", "block").orderBy("doc_id")
    ranked = blocked.withColumn("rank", F.row_number().over(in_block))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")) & (F.col("block") == F.col("_block"))
    copies = F.col("each") + F.when(F.col("before") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    return ranked.join(first, same).withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Rows that agree in doc_id, source and size share the copies that :func:`mix` gives them, in the
    order of a hash of their content, so reruns agree; equal rows are interchangeable. Rows travel as
    one struct, whatever their columns are called.
    """
    keys = ("id", "source", "size")
    each = mix(docs).groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"))
    each = each.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    keyed = docs.select(
        whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), _size().alias("size")
    )
    numbered = keyed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row"))))
    same = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("size") == F.col("mix_size"))
    upto = lambda i: F.floor(F.col("copies") * i / F.col("rows"))
    own = (upto(F.col("place")) - upto(F.col("place") - 1)).cast("int")
    taken = numbered.join(each, same).withColumn("own", own).filter("own > 0")
    return unfolded(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("own")))), docs.columns)
