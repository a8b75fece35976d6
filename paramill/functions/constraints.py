"""Typed design parameters: coercion, defaults, validation, names and texts.

Works on a table of designs, one row per design and one column per parameter; columns may
be text or numbers. Failing rows are marked, never raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramill import vocabulary as v
from paramill.functions.scoring import parse_number, with_numbers
from paramill.functions.text import lookup, strip
from paramill.operators.audit import _c

ERRORS, VALID = "errors", "is_valid"


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _blank_to_null(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def coerce_category(text: Column) -> Column:
    plain = F.lower(strip(text.cast("string")))
    return F.when(plain != "", F.coalesce(lookup(v.FLOW_TYPE_ALIASES, plain), plain))


def free_value(text: Column) -> Column:
    """``struct<num,txt>``: a number if the text is one, else the trimmed text, null if blank."""
    plain = strip(text.cast("string"))
    number = parse_number(plain)
    return F.when(
        plain != "", F.struct(number.alias("num"), F.when(number.isNull(), plain).alias("txt"))
    )


def _not_integral(number: Column) -> Column:
    # infinities and NaN are not integral either
    return F.isnan(number) | (F.abs(number) == float("inf")) | (number != F.floor(number))


def _quoted_text(text: Column) -> Column:
    """Text in the quotes of the message: double ones if it holds single ones only."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), text, F.lit("'"))
    )


def coerce_designs(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Known parameters in their declared type; problems are listed in ``_faults``.

    Columns the schema does not know become ``struct<num,txt>``; ``keys`` pass untouched.
    """
    keys = keys or []
    faults, columns = [], []
    # a number is parsed once, in a projection of its own, however many rules look at it
    measured = [n for n in df.columns if n not in keys and n in v.SPECS and v.SPECS[n].dtype != "category"]
    parsed = {n: f"_number_{i}" for i, n in enumerate(measured) if _is_text(df, n)}
    given = df
    df = with_numbers(df, {parsed[n]: _c(n) for n in parsed}) if parsed else df
    for name in given.columns:
        spec = v.SPECS.get(name)
        if name in keys:
            columns.append(_c(name))
        elif spec is None:
            columns.append(free_value(_c(name)).alias(name))
        elif spec.dtype == "category":
            columns.append(coerce_category(_c(name)).alias(name))
        else:
            number = F.col(parsed[name]) if name in parsed else _c(name).cast("double")
            if name in parsed:
                bad = _blank_to_null(_c(name)).isNotNull() & number.isNull()
                message = F.concat(
                    F.lit(f"{name}: could not convert string to float: "), _quoted_text(_c(name))
                )
                faults.append(F.when(bad, message))
            if spec.dtype == "int":
                faults.append(
                    F.when(_not_integral(number), F.lit(f"{name}: {name} {v.MSG_NOT_INTEGER}"))
                )
                number = F.when(~_not_integral(number), number).try_cast("int")
            columns.append(number.alias(name))
    faults = F.filter(F.array(*faults, F.lit(None).cast("string")), lambda e: e.isNotNull())
    return df.select(*columns, faults.alias("_faults"))


def apply_defaults(df: DataFrame) -> DataFrame:
    """Fill design fields that have a safe default where they are null; sizes are never guessed.

    A blank text is not null and stays.
    """
    filled = {}
    for name in v.DESIGN_FIELDS:
        default = v.SPECS[name].default
        if default is None:
            continue
        if name not in df.columns:
            filled[name] = F.lit(default)
        else:
            value = F.lit(str(default)) if _is_text(df, name) else F.lit(default).cast(df.schema[name].dataType)
            filled[name] = F.coalesce(_c(name), value)
    return df.withColumns(filled)


def _below(value: Column, bound: float) -> Column:
    # NaN compares with nothing
    return ~F.isnan(value) & (value < bound)


def _above(value: Column, bound: float) -> Column:
    return ~F.isnan(value) & (value > bound)


def validate_designs(
    df: DataFrame, required: list[str] | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Coerced parameters plus ``errors`` (in rule order) and ``is_valid``.

    Order: coercion, then choices and bounds per column, then missing fields, then geometry.
    Bounds are inclusive, the geometric rules strict.
    """
    keys = keys or []
    out = coerce_designs(df, keys)
    rules: list[Column] = []
    for name in df.columns:
        spec = v.SPECS.get(name)
        if spec is None or name in keys:
            continue
        value = _c(name)
        if spec.choices:
            rules.append(
                F.when(~value.isin(*spec.choices), f"{name} 必须是 {', '.join(spec.choices)} 之一")
            )
            continue
        number = value.cast("double")
        if spec.minimum is not None:
            rules.append(F.when(_below(number, spec.minimum), f"{name} 不能小于 {spec.minimum} {spec.unit}"))
        if spec.maximum is not None:
            rules.append(F.when(_above(number, spec.maximum), f"{name} 不能大于 {spec.maximum} {spec.unit}"))
    for name in required or []:
        missing = _c(name).isNull() if name in df.columns else F.lit(True)
        rules.append(F.when(missing, f"缺少必填参数: {name}"))

    def both(a: str, b: str, broken: Column, message: str) -> None:
        if a in df.columns and b in df.columns:
            rules.append(F.when(~F.isnan(_c(a)) & ~F.isnan(_c(b)) & broken, message))

    both("高", "water_depth", _c("water_depth") >= _c("高"), v.MSG_WATER_DEPTH)
    both("长", "wall_thickness", 2 * _c("wall_thickness") >= _c("长"), v.MSG_WALL_LENGTH)
    both("宽", "wall_thickness", 2 * _c("wall_thickness") >= _c("宽"), v.MSG_WALL_WIDTH)

    found = F.filter(F.array(*rules, F.lit(None).cast("string")), lambda e: e.isNotNull())
    return (
        out.withColumn(ERRORS, F.concat("_faults", found))
        .withColumn(VALID, F.size(ERRORS) == 0)
        .drop("_faults")
    )


def prepare_designs(df: DataFrame, keys: list[str] | None = None, model=None) -> DataFrame:
    """Optional imputation, defaults, then validation with all design fields required.

    Filter on ``is_valid`` for the usable designs and on its opposite for the rejects.
    """
    if model is not None:
        df = model.complete_designs(df)
    return validate_designs(apply_defaults(df), v.DESIGN_FIELDS, keys)


def valid_designs(df: DataFrame) -> DataFrame:
    """The valid ones of prepared designs.

    Rows are dropped by a generator: a filter would be pushed below the checks down to the scan, where every
    rule would parse its texts again.
    """
    return df.select("*", F.explode(F.when(F.col(VALID), F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named columns, null where the table has none of that name."""
    return df.select(*[_c(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names])


def unit_of(name: Column) -> Column:
    return lookup({n: s.unit for n, s in v.SPECS.items()}, name)


def display_name(name: Column) -> Column:
    """``name (unit)``, or the bare name without a unit."""
    unit = unit_of(name)
    return F.when(unit != "", F.concat(name, F.lit(" ("), unit, F.lit(")"))).otherwise(name)


def _fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))


def design_brief(df: DataFrame) -> Column:
    """One-line description of a prepared design.

    The load clause follows the retention time; alone it comes one line later. Decimals that
    end in an exact half are rounded up.
    """
    # fixed values: the texts of the brief
    def optional(name: str, text: Column) -> Column:
        return F.when(_c(name).isNotNull(), text) if name in df.columns else F.lit(None).cast("string")

    size = F.concat(
        F.lit("尺寸约为 "), _fixed(_c("长"), 1), F.lit("m x "), _fixed(_c("宽"), 1), F.lit("m x "),
        _fixed(_c("高"), 1), F.lit("m，"),
    )
    flow = F.concat(
        F.lit("流型为 "), _c("flow_type"), F.lit("，共有 "), _c("compartments").cast("string"), F.lit(" 个隔间，")
    )
    has_time = _c("水力停留时间").isNotNull() if "水力停留时间" in df.columns else F.lit(False)
    time = optional("水力停留时间", F.concat(F.lit("水力停留时间约 "), _fixed(_c("水力停留时间"), 1), F.lit(" 小时，")))
    load = optional("水力负荷", F.concat(F.lit("水力负荷约 "), _fixed(_c("水力负荷"), 2), F.lit(" m³/(m²·d)，")))
    return F.concat_ws(
        "",
        F.lit("请绘制一个人工湿地工程平面图，"),
        size,
        flow,
        time,
        F.when(has_time, load),
        F.lit("请以工程制图风格展示进水、出水、隔断和主要流向。"),
        F.when(~has_time, load),
        F.lit("图中应标注隔间编号、水流方向和进水口位置。"),
    )


def partition_layout(df: DataFrame, keys: list[str]) -> DataFrame:
    """Inner walls of valid designs: one row per wall between two compartments.

    The opening changes sides from wall to wall. Compartments are at most 100 by the schema,
    so a design never fans out further.
    """
    count, wall = _c("compartments"), _c("wall_thickness")
    inner = _c("长") - 2 * wall
    walls = F.when(count > 1, F.sequence(F.lit(1), count - 1))
    return df.select(*keys, "长", "宽", "water_depth", "wall_thickness", "partition_thickness", "compartments",
                     F.explode(walls).alias("wall_no")).select(
        *keys,
        "wall_no",
        (F.col("wall_no") * inner / count + wall - _c("partition_thickness") / 2).alias("wall_x"),
        F.when(F.col("wall_no") % 2 == 0, wall).otherwise(_c("宽") - 2 * wall).alias("opening_y"),
        (F.lit(0.35) * _c("water_depth")).alias("opening_height"),
    )
