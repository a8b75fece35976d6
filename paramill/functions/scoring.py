"""Value parsing, unit normalisation and candidate scoring as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramill import vocabulary as v
from paramill.functions import patterns as p
from paramill.functions.text import lookup, strip

# decimal digits of all scripts -> ASCII digits, derived from the Unicode database
_DIGITS = {
    c: str(unicodedata.decimal(c))
    for c in map(chr, range(128, sys.maxunicode + 1))
    if unicodedata.decimal(c, None) is not None
}

_DIGIT_RUN = r"\d(?:_?\d)*"
_FLOAT = (
    rf"(?i)^[+-]?(?:(?:{_DIGIT_RUN}\.?(?:{_DIGIT_RUN})?|\.{_DIGIT_RUN})(?:e[+-]?{_DIGIT_RUN})?"
    r"|inf(?:inity)?|nan)$"
)


def to_ascii_digits(text: Column) -> Column:
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(
        F.translate(text, "".join(_DIGITS), "".join(_DIGITS.values()))
    )


def parse_number(text: Column) -> Column:
    """A double from text by the usual literal rules; null where the text is no number.

    Gated by a pattern because Spark's own cast also takes ``10d`` and ``10f``.
    ``nan`` gives NaN, which callers that know only nulls must convert.
    """
    plain = to_ascii_digits(strip(text))
    return F.when(plain.rlike(_FLOAT), F.regexp_replace(plain, "_", "").try_cast("double"))


def with_numbers(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with a column per text: its number as :func:`parse_number` gives it.

    Every step is a projection of its own, which takes a text once however often the steps after it name it.
    """
    names = {n: f"_plain_{i}" for i, n in enumerate(texts)}
    df = df.withColumns({names[n]: strip(t) for n, t in texts.items()})
    df = df.withColumns({c: to_ascii_digits(F.col(c)) for c in names.values()})
    # a blank is no number, which takes no pattern to see
    gated = {n: F.when((F.col(c) != "") & F.col(c).rlike(_FLOAT), F.regexp_replace(c, "_", "").try_cast("double")) for n, c in names.items()}
    return df.withColumns(gated).drop(*names.values())


def parse_value(text: Column) -> Column:
    """Number, or the middle of a range; null where neither."""
    plain = to_ascii_digits(strip(text))
    low = F.regexp_extract(plain, p.RANGE, 1)
    high = F.regexp_extract(plain, p.RANGE, 2)
    middle = (low.try_cast("double") + high.try_cast("double")) / F.lit(2.0)
    simple = text.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    return (
        F.when(simple, text.try_cast("double")).when(low != "", middle).otherwise(parse_number(text))
    )


def unit_factor(unit: Column) -> Column:
    factors = {u: f for u, (f, _) in v.UNIT_CONVERSION.items()}
    return F.coalesce(lookup(factors, F.lower(unit)), F.lit(1.0))


def unit_name(unit: Column) -> Column:
    names = {u: n for u, (_, n) in v.UNIT_CONVERSION.items()}
    return F.coalesce(lookup(names, F.lower(unit)), unit)


def normalize_unit(value: Column, unit: Column) -> Column:
    """``struct<value,unit>`` in the standard unit; unknown units pass unchanged."""
    return F.struct((value * unit_factor(unit)).alias("value"), unit_name(unit).alias("unit"))


def looks_like_year(value: Column) -> Column:
    """True if the decimal text of ``value`` has a stand-alone 19xx or 20xx.

    Numbers from ten million up are written out in full first, since Spark's text form
    switches to an exponent there.
    """
    size = F.abs(value)
    text = value.cast("string")
    full = F.regexp_replace(text.try_cast("decimal(38,12)").cast("string"), "0+$", "")
    shown = F.when((size >= 1e7) & (size < 1e16), full).otherwise(text)
    return F.coalesce(shown.rlike(r"(?<![\w])(?:19|20)\d{2}(?![\w])"), F.lit(False))


def _fault(cost: float, reason: str) -> Column:
    return F.struct(F.lit(cost).alias("cost"), F.lit(reason).alias("reason"))


def assess(parameter: Column, value: Column, unit: Column, distance: Column) -> Column:
    """Score of a candidate: ``struct<confidence,quality_status,quality_reason>``.

    ``value`` and ``unit`` are the ones read from the text, before normalisation.
    """
    expected = lookup(v.EXPECTED_GROUP, parameter)
    group = lookup(v.UNIT_GROUP, F.lower(unit))
    score, reason = score_and_reason(parameter, value, unit, distance, expected, group)
    return F.struct(
        score.alias("confidence"), status_of(score).alias("quality_status"), reason.alias("quality_reason")
    )


def status_of(score: Column) -> Column:
    return (
        F.when(score >= v.ACCEPT_SCORE, v.ACCEPTED)
        .when(score >= v.REVIEW_SCORE, v.REVIEW)
        .otherwise(v.REJECTED)
    )


def score_and_reason(
    parameter: Column, value: Column, unit: Column, distance: Column, expected: Column, group: Column
) -> tuple[Column, Column]:
    """Score and reasons when the unit groups expected and found are already looked up.

    The deductions are subtracted one after the other so that the doubles meet the limits
    exactly.
    """
    expected = F.coalesce(expected, F.lit(""))
    has_unit = F.coalesce(unit, F.lit("")) != ""
    actual = F.coalesce(group, F.lit(""))

    far = distance > v.NEAR_KEYWORD
    fault = (
        F.when(expected == "unitless", F.when(has_unit, _fault(0.45, v.REASON_UNITLESS)))
        .when((expected != "") & ~has_unit, _fault(0.55, v.REASON_NO_UNIT))
        .when((expected != "") & (actual != expected), _fault(0.65, v.REASON_WRONG_UNIT))
        .when(has_unit & (actual == ""), _fault(0.2, v.REASON_UNKNOWN_UNIT))
    )
    year = ~has_unit & looks_like_year(value)
    # NaN never passes the range test
    acid = (parameter == "pH") & ~F.coalesce((value >= 0) & (value <= 14), F.lit(False))
    negative = (expected != "temperature") & (value < 0)

    score = F.lit(1.0) - F.when(far, 0.25).otherwise(0.0) - F.coalesce(fault["cost"], F.lit(0.0))
    score = F.when(year | acid, 0.0).otherwise(score) - F.when(negative, 0.5).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))

    reason = F.concat_ws(
        "; ",
        F.when(far, v.REASON_FAR),
        fault["reason"],
        F.when(year, v.REASON_YEAR),
        F.when(acid, v.REASON_PH),
        F.when(negative, v.REASON_NEGATIVE),
    )
    return score, reason
