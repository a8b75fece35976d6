"""Exact order statistics without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# values of one bracket that may be gathered in one task
GATHER_LIMIT = 20_000
# bounds of the accuracy of the approximate pass: its rank error is 1 / accuracy of the rows
MIN_ACCURACY, MAX_ACCURACY = 100, 10_000


class _Values:
    """An expression with ``n`` non-null values, shared by the ranks searched in it."""

    def __init__(self, expression: Column, n: int) -> None:
        self.expression, self.n = expression, n
        # coarse where a coarse bracket is small enough already
        self.accuracy = max(MIN_ACCURACY, min(MAX_ACCURACY, math.ceil(10 * n / GATHER_LIMIT)))
        self.parts: dict[tuple, _Values] = {}

    def bracket(self, rank: int) -> tuple[int, int]:
        """Steps of 1 / accuracy that enclose ``rank`` with the error on both sides."""
        at = rank * self.accuracy // self.n
        return max(at - 2, 0), min(at + 3, self.accuracy)

    def part(self, key: tuple, condition: Column, n: int) -> _Values:
        if key not in self.parts:
            self.parts[key] = _Values(F.when(condition, self.expression), n)
        return self.parts[key]


def select_hashes(hashes: DataFrame, ranks: Sequence[int], bits: int = 52, step: int = 12) -> list[int]:
    """Exact k-th smallest values (ranks from 0) of the one column, hashes below 2 ** ``bits``.

    Hashes are spread evenly, so counts of their leading digits bracket all ranks at once: one pass
    over n hashes leaves about n / 4096 to each bracket, and a bracket whose least and greatest
    hash agree is settled. Nothing is sorted or gathered.
    """
    column = F.col(hashes.columns[0])
    found: dict[int, int] = {}
    # rank -> (digits known so far, rank among the hashes that begin with them)
    open_ = {r: (0, r) for r in ranks}
    known = 0
    while open_:
        own = hashes
        if known:
            own = hashes.where(F.shiftright(column, bits - known).isin(sorted({p for p, _ in open_.values()})))
        before, known = known, min(known + step, bits)
        counted = own.groupBy(F.shiftright(column, bits - known).alias("p")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        rows = sorted(counted.collect(), key=lambda r: r["p"])
        following = {}
        for rank, (prefix, inner) in open_.items():
            for r in rows:
                if r["p"] >> (known - before) != prefix:
                    continue
                if inner < r["n"]:
                    if r["low"] == r["high"]:
                        found[rank] = r["low"]
                    else:
                        following[rank] = (r["p"], inner)
                    break
                inner -= r["n"]
            else:
                raise ValueError(f"rank {rank} lies beyond the hashes")
        open_ = following
    return [found[r] for r in ranks]


def select_ranks(df: DataFrame, targets: Sequence[tuple[Column, int, int]]) -> list[float]:
    """Exact k-th smallest values: one per target ``(numeric expression, count, rank from 0)``.

    ``count`` is the number of non-null values of the expression. Each round runs two
    aggregates over all open targets: an approximate quantile brackets the rank, then exact
    counts tell on which side it lies, and whether it is one of the bracket's ends. A bracket
    holds a few steps of the rows it came from and never a value more frequent than that
    except as an end, so few rounds bring it below GATHER_LIMIT, where the values inside are
    sorted.
    """
    shared: dict[int, _Values] = {}
    todo: dict[int, tuple[_Values, int]] = {}
    for i, (expression, n, rank) in enumerate(targets):
        todo[i] = (shared.setdefault(id(expression), _Values(expression, n)), rank)
    done: dict[int, float] = {}
    while todo:
        small = {i: t for i, t in todo.items() if t[0].n <= GATHER_LIMIT}
        if small:
            done.update(_sorted_picks(df, small))
            todo = {i: t for i, t in todo.items() if i not in small}
            continue
        ends = _approximate_ends(df, {(t[0], t[0].bracket(t[1])) for t in todo.values()})
        counts = _counts_around(df, ends)
        following = {}
        for i, (values, rank) in todo.items():
            key = (values, values.bracket(rank))
            low, high = ends[key]
            below, at_low, inside, at_high = counts[key]
            e = values.expression
            if rank < below:
                following[i] = (values.part((key[1], "below"), e < low, below), rank)
            elif rank < below + at_low:
                done[i] = low
            elif rank < below + at_low + inside:
                part = values.part((key[1], "inside"), (e > low) & (e < high), inside)
                following[i] = (part, rank - below - at_low)
            elif rank < below + at_low + inside + at_high:
                done[i] = high
            else:
                passed = below + at_low + inside + at_high
                following[i] = (values.part((key[1], "above"), e > high, values.n - passed), rank - passed)
        todo = following
    return [done[i] for i in range(len(targets))]


def _sorted_picks(df: DataFrame, small: dict[int, tuple[_Values, int]]) -> dict[int, float]:
    """Ranks of value sets that fit a task: sort each set once, pick from it."""
    sets = list({t[0] for t in small.values()})
    ranks = {s: sorted({r for v, r in small.values() if v is s}) for s in sets}
    aggs = []
    for j, s in enumerate(sets):
        ordered = F.sort_array(F.collect_list(s.expression))
        aggs.append(F.array(*[F.get(ordered, F.lit(r)) for r in ranks[s]]).alias(f"r{j}"))
    row = df.agg(*aggs).first()
    place = {s: j for j, s in enumerate(sets)}
    return {i: row[f"r{place[v]}"][ranks[v].index(r)] for i, (v, r) in small.items()}


def _approximate_ends(df: DataFrame, keys: set) -> dict:
    """Approximate values at both ends of each bracket; the outermost ends are exact."""
    keys = sorted(keys, key=lambda k: (id(k[0]), k[1]))
    sets = list(dict.fromkeys(k[0] for k in keys))
    steps = {s: sorted({x for k in keys if k[0] is s for x in k[1]}) for s in sets}
    aggs = []
    for j, s in enumerate(sets):
        probs = [x / s.accuracy for x in steps[s]]
        aggs += [
            F.approx_percentile(s.expression, probs, s.accuracy).alias(f"p{j}"),
            F.min(s.expression).alias(f"min{j}"),
            F.max(s.expression).alias(f"max{j}"),
        ]
    row = df.agg(*aggs).first()
    ends = {}
    for s, (low, high) in keys:
        j = sets.index(s)
        at = dict(zip(steps[s], row[f"p{j}"], strict=True))
        ends[s, (low, high)] = (
            row[f"min{j}"] if low == 0 else at[low],
            row[f"max{j}"] if high == s.accuracy else at[high],
        )
    return ends


def _counts_around(df: DataFrame, ends: dict) -> dict:
    """Exact counts below, at, between and at the upper end of each bracket."""
    aggs = []
    for j, ((s, _), (low, high)) in enumerate(ends.items()):
        e = s.expression
        aggs += [
            F.count_if(e < low).alias(f"a{j}"),
            F.count_if(e == low).alias(f"b{j}"),
            F.count_if((e > low) & (e < high)).alias(f"c{j}"),
            F.count_if((e == high) & (e > low)).alias(f"d{j}"),
        ]
    row = df.agg(*aggs).first()
    return {key: tuple(row[f"{x}{j}"] for x in "abcd") for j, key in enumerate(ends)}


def exact_quantiles(df: DataFrame, expressions: Sequence[Column], probs: Sequence[float]) -> list[list[float | None]]:
    """Linearly interpolated quantiles of several numeric expressions, nulls ignored.

    One list per expression; None where it has no values.
    """
    expressions = [e.cast("double") for e in expressions]
    sizes = df.agg(*[F.count(e).alias(str(i)) for i, e in enumerate(expressions)]).first()
    targets, places = [], []
    for i, e in enumerate(expressions):
        for q in probs:
            n = sizes[i]
            if n == 0:
                continue
            position = q * (n - 1)
            floor = min(int(position), n - 1)
            part = position - floor
            targets.append((e, n, floor))
            places.append((i, q, "low", part))
            if part > 0:
                targets.append((e, n, floor + 1))
                places.append((i, q, "high", part))
    found = select_ranks(df, targets) if targets else []
    low: dict[tuple[int, float], float] = {}
    out: dict[tuple[int, float], float] = {}
    for (i, q, end, part), value in zip(places, found, strict=True):
        if end == "low":
            low[i, q] = out[i, q] = value
        else:
            out[i, q] = low[i, q] + (value - low[i, q]) * part
    return [[out.get((i, q)) for q in probs] for i in range(len(expressions))]
