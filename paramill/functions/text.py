"""Column functions over page text and short context windows.

All of these are plain Spark expressions; positions are 0-based character offsets.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramill import vocabulary as v
from paramill.functions import patterns as p


def sql_literal(value: object) -> str:
    """``value`` as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


@functools.cache
def _map_sql(entries: tuple) -> str:
    # one SQL text: building hundreds of literal columns one by one costs seconds per query
    cells = []
    for key, value in entries:
        if isinstance(value, tuple):
            inner = ", ".join(f"'{n}', {sql_literal(x)}" for n, x in value)
            cells += [sql_literal(key), f"named_struct({inner})"]
        else:
            cells += [sql_literal(key), sql_literal(value)]
    return f"map({', '.join(cells)})"


def literal_map(table: dict) -> Column:
    """A constant map; Catalyst folds it into one literal."""
    return F.expr(_map_sql(tuple(table.items())))


def lookup(table: dict, key: Column) -> Column:
    """Dictionary lookup, null when the key is absent."""
    return F.try_element_at(literal_map(table), key)


def lookup_row(table: dict[str, dict], key: Column) -> Column:
    """As :func:`lookup` for rows of several named values, giving a struct."""
    rows = tuple((k, tuple(row.items())) for k, row in table.items())
    return F.try_element_at(F.expr(_map_sql(rows)), key)


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, p.TRIM, "")


# --- number mentions -------------------------------------------------------------------


# separates pieces of a page; a code point that text interchange never uses
_MARK = "\uffff"


def mention_pieces(text: Column) -> Column:
    """Page text cut at its mentions: ``[gap, hit, gap, hit, ..., gap]``.

    One pass of the pattern marks both ends of each mention, and a cheap split on the mark
    cuts the pieces. Text that holds the mark itself is cut by matching twice.
    """
    marked = F.regexp_replace(text, p.MENTION, f"{_MARK}$0{_MARK}")
    hits = F.regexp_extract_all(text, F.lit(p.MENTION), F.lit(0))
    gaps = F.split(text, p.MENTION, -1)
    pairs = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, F.coalesce(h, F.lit("")))))
    slow = F.slice(pairs, 1, F.size(pairs) - 1)
    return F.when(F.contains(text, F.lit(_MARK)), slow).otherwise(F.split(marked, _MARK, -1))


def mention_windows(pieces: Column, reach: int = v.CONTEXT_CHARS) -> Column:
    """``array<struct<hit,before,after>>``: each mention with ``reach`` characters around it.

    A window is put together from neighbouring pieces only, so the work per page stays
    linear in its length however many numbers it holds: a mention is at least one
    character long, hence ``reach`` mentions on a side always cover the window.
    """
    count = F.floor(F.size(pieces) / 2).cast("int")

    def window(i: Column) -> Column:
        at = 2 * i + 1
        gap_before, gap_after = pieces[at - 1], pieces[at + 1]
        back = F.least(i, F.lit(reach))
        ahead = F.least(count - 1 - i, F.lit(reach))
        # slice counts from 1
        before = F.when(F.length(gap_before) >= reach, gap_before).otherwise(
            F.array_join(F.slice(pieces, at - 2 * back, 2 * back + 1), "")
        )
        after = F.when(F.length(gap_after) >= reach, gap_after).otherwise(
            F.array_join(F.slice(pieces, at + 2, 2 * ahead + 1), "")
        )
        return F.struct(
            pieces[at].alias("hit"),
            F.right(before, F.lit(reach)).alias("before"),
            F.left(after, F.lit(reach)).alias("after"),
        )

    windows = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), window)
    return F.when(count > 0, windows)


def mention_offsets(pieces: Column) -> Column:
    """``array<struct<start,end>>`` of the mentions, summed from the piece lengths."""
    lengths = F.transform(pieces, lambda x, i: F.struct(F.length(x).alias("n"), (i % 2 == 1).alias("is_hit")))
    init = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")
    )

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + piece["n"]
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        out = F.when(piece["is_hit"], F.array_append(acc["out"], span)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(lengths, init, step, lambda acc: acc["out"])


def mention_value(hit: Column) -> Column:
    """The number or range a mention starts with, as written."""
    return F.regexp_extract(hit, p.MENTION_VALUE, 0)


def mention_unit(hit: Column, value: Column) -> Column:
    """The unit a mention ends with, as written; empty when there is none."""
    return F.regexp_replace(F.substr(hit, F.length(value) + 1), rf"(?U)^{p.SPACE}+", "")


# --- keywords ----------------------------------------------------------------------------


def normalize_keyword(word: Column) -> Column:
    """Parameter a spelling stands for, null if unknown."""
    return lookup(v.ALIAS_PARAMETER, F.lower(word))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside the lambdas of ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _occurrences(text: Column, spellings: list[dict]) -> Column:
    """All places of some spellings: structs of ``ord, position`` and the named extras.

    Only spellings that occur at all are cut out by their pattern; the rest cost one
    substring test. Non-overlapping, by spelling, then left to right.
    """
    rows = ", ".join(
        "named_struct(" + ", ".join(f"'{k}', {sql_literal(x)}" for k, x in row.items()) + ")" for row in spellings
    )
    extras = [k for k in spellings[0] if k not in ("ord", "alias", "pattern")]

    def places(lowered: Column, s: Column) -> Column:
        size = F.length(s["alias"])
        gaps = F.call_function("split", lowered, s["pattern"], F.lit(-1))
        init = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(
            F.slice(gaps, 1, F.size(gaps) - 1),
            init,
            lambda acc, gap: F.struct(
                (acc["at"] + F.length(gap) + size).alias("at"),
                F.array_append(acc["out"], acc["at"] + F.length(gap)).alias("out"),
            ),
            lambda acc: acc["out"],
        )
        return F.transform(
            starts,
            lambda at: F.struct(
                s["ord"].alias("ord"), at.alias("position"), *[s[k].alias(k) for k in extras]
            ),
        )

    def search(lowered: Column) -> Column:
        present = F.filter(F.expr(f"array({rows})"), lambda s: F.contains(lowered, s["alias"]))
        return F.flatten(F.transform(present, lambda s: places(lowered, s)))

    return let(F.lower(text), search)


def keyword_occurrences(text: Column, parameters: list[str] | None = None) -> Column:
    """Every spelling found: ``array<struct<ord,position,parameter,name>>``.

    ``name`` is the spelling. Ordered by its place in the vocabulary, then by position;
    ``parameters`` restricts the search.
    """
    spellings = [
        {"ord": i, "alias": a, "pattern": p.alias_pattern(a), "parameter": q, "name": a}
        for i, (a, q) in enumerate(v.ALIAS_PARAMETER.items())
        if parameters is None or q in parameters
    ]
    return _occurrences(text, spellings)


def nearest_keyword(context: Column, value_pos: Column | None = None) -> Column:
    """Keyword nearest to ``value_pos``: ``struct<parameter,alias,position>`` or null.

    A keyword after the value costs a fixed penalty; ties go to the earlier spelling.
    Without a position the first occurrence in vocabulary order is taken.
    """
    found = keyword_occurrences(context, v.NUMERIC_PARAMETERS)
    if value_pos is None:
        best = F.get(found, F.lit(0))
        return F.when(best.isNotNull(), F.struct(best["parameter"].alias("parameter"),
                                                 best["name"].alias("alias"),
                                                 best["position"].alias("position")))

    def key(o: Column) -> Column:
        far = F.abs(o["position"] - value_pos)
        late = F.when(o["position"] > value_pos, v.AFTER_PENALTY).otherwise(0)
        return F.struct(
            (far + late).alias("cost"), o["ord"].alias("ord"), o["position"].alias("position"),
            o["parameter"].alias("parameter"), o["name"].alias("name"),
        )

    best = F.array_min(F.transform(found, key))
    return F.when(
        F.abs(best["position"] - value_pos) <= v.KEYWORD_REACH,
        F.struct(best["parameter"].alias("parameter"), best["name"].alias("alias"),
                 best["position"].alias("position")),
    )


_ALIAS_ORDER = {a: i for i, a in enumerate(v.ALIAS_PARAMETER)}


def with_nearest_alias(df: DataFrame, before: str, rest: str, keep: Column | None = None) -> DataFrame:
    """Keep mentions that have a keyword near, adding ``matched_alias`` and ``keyword_pos``.

    ``before`` ends where a mention starts and ``rest`` starts with it. No spelling runs
    across the start of a mention, so one look back and one look ahead settle the choice
    without listing occurrences: same answer as :func:`nearest_keyword`. The steps are
    projections of their own and the rows are dropped by a generator instead of a filter:
    a filter would be pushed below the projections and run every pattern again.
    """
    columns = df.columns
    behind, ahead, wins = F.col("_behind"), F.col("_ahead"), F.col("_ahead_wins")
    # the greedy prefix leaves the last spelling; what follows it gives its distance
    df = df.withColumn("_tail", F.regexp_extract(F.lower(before), rf"(?s)^.*({p.NUMERIC_ALIAS}.*)$", 1))
    df = df.withColumn("_behind", F.length("_tail"))
    # one ahead is at least a character away and pays the penalty: only search where it can win
    head = F.regexp_extract(F.lower(rest), rf"(?s)^(.+?{p.NUMERIC_ALIAS})", 1)
    df = df.withColumn("_head", F.when((behind == 0) | (behind > v.AFTER_PENALTY), head).otherwise(""))
    df = df.withColumn("_back_alias", F.regexp_extract("_tail", "^" + p.NUMERIC_ALIAS, 0)).withColumn(
        "_ahead_alias", F.regexp_extract("_head", p.NUMERIC_ALIAS, 0)
    )
    df = df.withColumn("_ahead", F.length("_head") - F.length("_ahead_alias"))
    cost = ahead + v.AFTER_PENALTY
    earlier = lookup(_ALIAS_ORDER, F.col("_ahead_alias")) < lookup(_ALIAS_ORDER, F.col("_back_alias"))
    df = df.withColumn(
        "_ahead_wins",
        (ahead > 0) & ((behind == 0) | (cost < behind) | ((cost == behind) & earlier)),
    )
    within = F.when(wins, ahead <= v.KEYWORD_REACH).otherwise((behind > 0) & (behind <= v.KEYWORD_REACH))
    if keep is not None:
        within = within & keep
    found = F.struct(
        F.when(wins, F.col("_ahead_alias")).otherwise(F.col("_back_alias")).alias("matched_alias"),
        (F.length(before) + F.when(wins, ahead).otherwise(-behind)).alias("keyword_pos"),
    )
    return df.select(*columns, F.explode(F.when(within, F.array(found))).alias("_k")).select(
        *columns, "_k.matched_alias", "_k.keyword_pos"
    )


def category_of(parameter: Column) -> Column:
    """Category of a parameter, with a default for unknown ones."""
    return F.coalesce(lookup(v.PARAMETER_CATEGORY, parameter), F.lit(v.OTHER_CATEGORY))


_CLASSIFIED = list(v.ALIAS_PARAMETER)
#: Place in the vocabulary of the first spelling that stands wherever a spelling stands, and each place's category.
_FIRST_PLACE = {a: min(map(_CLASSIFIED.index, p.beginnings(a, _CLASSIFIED))) for a in _CLASSIFIED}
_PLACE_CATEGORY = {i: v.PARAMETER_CATEGORY[v.ALIAS_PARAMETER[a]] for i, a in enumerate(_CLASSIFIED)}


def classify_text(text: Column) -> Column:
    """Category of the first known keyword, first meaning vocabulary order.

    One pass over the text, however many categories there are.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(p.longest_alias(_CLASSIFIED)), F.lit(1)))
    first = F.array_min(F.transform(found, lambda a: lookup(_FIRST_PLACE, a)))
    return F.coalesce(lookup(_PLACE_CATEGORY, first), F.lit(v.OTHER_CATEGORY))


# --- water roles ---------------------------------------------------------------------------

_ROLE_ALIASES: list[tuple[str, str]] = [(a, r) for r, names in v.ROLES.items() for a in names]


def role_occurrences(text: Column) -> Column:
    """Every role spelling found: ``array<struct<ord,position,role>>`` in vocabulary order."""
    return _occurrences(
        text,
        [
            {"ord": i, "alias": a, "pattern": p.quoted(a), "role": r}
            for i, (a, r) in enumerate(_ROLE_ALIASES)
        ],
    )


def water_role(context: Column, anchor: Column | None = None) -> Column:
    """Role word nearest to ``anchor`` within its sentence, or ``unspecified``.

    Without an anchor: the first role spelling, in vocabulary order, found anywhere.
    """
    unspecified = F.lit(v.ROLE_UNSPECIFIED)
    if anchor is None:
        lowered = F.lower(context)
        tests = [F.when(F.contains(lowered, F.lit(a)), F.lit(r)) for a, r in _ROLE_ALIASES]
        return F.coalesce(*tests, unspecified)

    sentence, at = sentence_around(context, anchor)
    around = F.struct(sentence.alias("text"), at.alias("at"))
    return F.coalesce(let(around, lambda s: role_in_sentence(s["text"], s["at"])), unspecified)


def sentence_around(context: Column, anchor: Column) -> tuple[Column, Column]:
    """The lower-case sentence that holds ``anchor``, and the anchor's place in it."""
    marks = f"[{v.SENTENCE_MARKS}]"
    left = F.lower(F.regexp_replace(F.left(context, anchor), rf"(?s)^.*{marks}", ""))
    right = F.lower(F.regexp_replace(F.substr(context, anchor + 1), rf"(?s){marks}.*$", ""))
    return F.concat(left, right), F.length(left)


def role_in_sentence(sentence: Column, at: Column) -> Column:
    """Nearest role spelling within reach of ``at``, null if none.

    Per spelling only two places can win: the last start up to ``at`` and the first one
    after it.
    """
    rows = ", ".join(
        f"named_struct('ord', {i}, 'alias', {sql_literal(a)}, 'role', {sql_literal(r)})"
        for i, (a, r) in enumerate(_ROLE_ALIASES)
    )
    spellings = F.expr(f"array({rows})")

    def nearest(s: Column) -> Column:
        size = F.length(s["alias"])
        upto = F.left(sentence, at + size)
        rest = F.call_function("substring_index", upto, s["alias"], F.lit(-1))
        back = F.when(F.contains(upto, s["alias"]), at - (F.length(upto) - F.length(rest) - size))
        # locate counts from 1 and gives 0 when there is none
        place = F.call_function("locate", s["alias"], sentence, at + 2)
        ahead = F.when(place > 0, place - 1 - at)
        cost = F.least(back, ahead + v.AFTER_PENALTY)
        return F.struct(
            cost.alias("cost"),
            s["ord"].alias("ord"),
            F.when(cost == back, back).otherwise(ahead).alias("far"),
            s["role"].alias("role"),
        )

    found = F.filter(spellings, lambda s: F.contains(sentence, s["alias"]))
    best = F.array_min(F.transform(found, nearest))
    return F.get(F.filter(F.array(best), lambda b: b["far"] <= v.ROLE_REACH), F.lit(0))["role"]
