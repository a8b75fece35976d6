"""The registered queries in SQL, for checking on another engine.

The SQL does not repeat the text matching. Report pages are built from known sentences, so
the expected records follow from which sentence a page holds; the other queries are stated
directly. Numbers that sums can disturb in the last digits are rounded on both sides.
"""

from __future__ import annotations

from paramill import vocabulary as v
from paramill.operators.tables import training_columns
from paramill.plans.sample_inputs import FILLER, SENTENCES

ORACLES: dict[str, str] = {}


def lit(x: object) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


# --- expected outcome of each sentence --------------------------------------------------
# alias, unit as written, role, score, reason; None: no record
_NO_UNIT, _WRONG = v.REASON_NO_UNIT, v.REASON_WRONG_UNIT
_EXPECTED: list[tuple | None] = [
    ("cod", "COD", "mg/L", "influent", "1.0", ""),
    ("total nitrogen", "总氮", "ug/L", "effluent", "1.0", ""),
    ("hrt", "水力停留时间", "d", "not_applicable", "1.0", ""),
    ("hydraulic loading rate", "水力负荷", "m³/(m²·d)", "not_applicable", "1.0", ""),
    ("bod5", "BOD", "mg/L", "influent", "1.0", ""),
    ("hrt", "水力停留时间", "mg/L", "not_applicable", "1.0-0.65", _WRONG),
    ("length", "长", "", "not_applicable", "1.0-0.55", _NO_UNIT),
    ("ph", "pH", "", "effluent", "acid", ""),
    ("tp", "总磷", "", "unspecified", "0.0", f"{_NO_UNIT}; {v.REASON_YEAR}"),
    ("cod", "COD", "mg/L", "unspecified", "1.0-0.25", v.REASON_FAR),
    ("氨氮", "氨氮", "mg/L", "influent", "1.0", ""),
    ("temperature", "温度", "°C", "not_applicable", "1.0", ""),
    ("ammonia nitrogen", "氨氮", "mg/L", "effluent", "1.0", ""),
    None,
    ("cod", "COD", "%", "removal", "1.0-0.65", _WRONG),
    ("do", "DO", "g/m3", "unspecified", "1.0", ""),
]
_UNIT = {"ug/L": ("0.001", "mg/L"), "d": ("24.0", "h"), "g/m3": ("1.0", "mg/L")}


def _templates() -> str:
    rows = []
    for i, ((before, kind, after), expected) in enumerate(zip(SENTENCES, _EXPECTED, strict=True)):
        alias, parameter, unit, role, score, reason = expected or (None, None, "mg/L" if i == 12 else "", None, "0.0", "")
        factor, name = _UNIT.get(unit, ("1.0", unit))
        category = v.PARAMETER_CATEGORY.get(parameter) if parameter else None
        tail = f" {unit}" if unit else ""
        score_sql = "CAST(-1 AS DOUBLE)" if score == "acid" else "-".join(
            f"CAST({x} AS DOUBLE)" for x in score.split("-")
        )
        cells = [
            str(i), lit(before), lit(kind), lit(after), lit(tail), lit(unit), lit(alias), lit(parameter),
            lit(category), lit(role), score_sql, lit(reason), f"CAST({factor} AS DOUBLE)", lit(name),
        ]
        rows.append("(" + ", ".join(cells) + ")")
    return "VALUES " + ", ".join(rows)


_NUMBER = """CASE kind WHEN 'n' THEN CAST(1 + k % 40 AS VARCHAR) WHEN 'p' THEN p
 WHEN 'frac' THEN '0.' || lpad(CAST(1 + k % 97 AS VARCHAR), 2, '0')
 WHEN 'range' THEN CAST(1 + k % 40 AS VARCHAR) || '~' || CAST(11 + k % 40 AS VARCHAR)
 WHEN 'half' THEN CAST(1 + k % 40 AS VARCHAR) || '.5' WHEN 'y' THEN CAST(1990 + k % 30 AS VARCHAR)
 ELSE '-' || CAST(1 + k % 40 AS VARCHAR) END"""

_FILL = len(FILLER)
_COUNT = len(SENTENCES)



def _mentions(rows: str, slots: str) -> str:
    """Mentions and records of the pages of ``rows`` (k, c, p, pdf_name, page); ``slots`` says which
    sentences a page holds."""
    return f"""WITH tpl(t, pre, kind, post, tail, raw_unit, alias, parameter, category, role, score, reason, factor, unit)
 AS ({_templates()}),
ord AS ({rows}),
slots AS ({slots}),
said AS (SELECT k, pdf_name, page, slot, tpl.*, {_NUMBER} AS val FROM slots JOIN tpl USING (t)),
texts AS (SELECT k, {lit(FILLER)} || string_agg(pre || val || post || {lit(FILLER)}, '' ORDER BY slot) AS text,
 max(CASE WHEN slot = 0 THEN length(pre || val || post) END) AS first_size FROM said GROUP BY k),
spots AS (SELECT said.*, text, {_FILL} + length(pre) + CASE WHEN slot = 1 THEN first_size + {_FILL} ELSE 0 END AS start_at
 FROM said JOIN texts USING (k)),
m AS (SELECT *, start_at + length(val) + length(tail) AS end_at, greatest(start_at - 40, 0) AS left_at,
 least(start_at + length(val) + length(tail) + 40, length(text)) AS right_at FROM spots),
rec AS (SELECT *, substr(text, left_at + 1, right_at - left_at) AS context,
 (CASE WHEN kind = 'range' THEN 6 + k % 40 ELSE CAST(split_part(val, '~', 1) AS DOUBLE) END) AS parsed,
 CASE WHEN score < 0 THEN CASE WHEN k % 40 > 12 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE score END AS confidence,
 CASE WHEN score < 0 AND k % 40 > 12 THEN {lit(v.REASON_PH)} ELSE reason END AS quality_reason
 FROM m WHERE alias IS NOT NULL),
d AS (SELECT pdf_name || ':p' || page || ':' || row_number() OVER (PARTITION BY pdf_name ORDER BY page, slot) AS record_id,
 pdf_name, page, role AS water_role, 'pending' AS review_status,
 CASE WHEN confidence >= 0.7 THEN 'accepted_candidate' WHEN confidence >= 0.4 THEN 'review_required' ELSE 'rejected' END
 AS quality_status, confidence, quality_reason, category, parameter, alias AS matched_alias,
 CAST(parsed AS DOUBLE) * factor AS value, unit, val AS raw_value, raw_unit, context FROM rec)
"""


_ONE_SLOT = f"SELECT *, 0 AS slot, k % {_COUNT} AS t FROM ord"
MENTIONS = _mentions(
    "SELECT o_orderkey AS k, o_custkey AS c, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS p, "
    "'study_' || o_custkey || '.pdf' AS pdf_name, o_orderkey + 1 AS page FROM orders",
    f"{_ONE_SLOT} UNION ALL SELECT *, 1 AS slot, (k // {_COUNT} + c) % {_COUNT} AS t FROM ord",
)
ORACLES["extract_documents"] = _mentions(
    "SELECT doc_id AS k, CAST(CAST(n_chars + 0.5 AS DECIMAL(14,2)) AS VARCHAR) AS p, 'doc_' || doc_id AS pdf_name, "
    "1::BIGINT AS page FROM documents",
    _ONE_SLOT,
) + "SELECT * FROM d"
ORACLES["extract_conversations"] = _mentions(
    "SELECT conv_id * 10 + turn AS k, CAST(CAST(conv_id + 0.25 AS DECIMAL(14,2)) AS VARCHAR) AS p, "
    "'conv_' || conv_id AS pdf_name, turn + 1 AS page FROM conversations",
    _ONE_SLOT,
) + "SELECT * FROM d"
_ACCEPTED = "quality_status = 'accepted_candidate'"
_AMBIGUOUS = f"(category = '{v.WATER_QUALITY}' AND water_role = 'unspecified')"

ORACLES["scan_number_units"] = MENTIONS + (
    "SELECT pdf_name, page, CAST(slot AS INTEGER) AS mention, val AS raw_value, raw_unit FROM m"
)
ORACLES["match_offsets"] = MENTIONS + (
    'SELECT pdf_name, page, CAST(slot AS INTEGER) AS mention, CAST(start_at AS INTEGER) AS "start", '
    'CAST(end_at AS INTEGER) AS "end" FROM m'
)
ORACLES["context_window"] = MENTIONS + (
    "SELECT pdf_name, page, CAST(slot AS INTEGER) AS mention, substr(text, left_at + 1, right_at - left_at) AS context, "
    "CAST(start_at - left_at AS INTEGER) AS value_pos FROM m"
)
ORACLES["extract_detail"] = ORACLES["extract_listed_twice"] = MENTIONS + "SELECT * FROM d"
ORACLES["extract_summary"] = MENTIONS + (
    f"SELECT pdf_name, quality_status, category, parameter, unit, count(*) AS {v.SUMMARY_COUNT} FROM d GROUP BY ALL"
)
ORACLES["quality_report"] = MENTIONS + (
    f"SELECT quality_status, quality_reason, count(*) AS {v.QUALITY_COUNT} FROM d GROUP BY ALL"
)
ORACLES["review_table"] = MENTIONS + (
    "SELECT pdf_name, page, water_role, quality_status, parameter, value, unit, context FROM d "
    f"WHERE NOT {_ACCEPTED} OR {_AMBIGUOUS}"
)
_TRAINING = f"""tr AS (SELECT pdf_name, CASE WHEN category = '{v.WATER_QUALITY}' THEN parameter || '__' || water_role
 ELSE parameter END AS tp, value FROM d WHERE {_ACCEPTED} AND NOT {_AMBIGUOUS})"""
ORACLES["training_pivot"] = MENTIONS + f", {_TRAINING} SELECT pdf_name, " + ", ".join(
    f"round(avg(value) FILTER (WHERE tp = '{c}'), 9) AS \"{c}\"" for c in training_columns()
) + " FROM tr GROUP BY pdf_name"
ORACLES["run_counts"] = MENTIONS + f""", {_TRAINING}
SELECT count(*) AS detail_rows, count(*) FILTER (WHERE {_ACCEPTED} AND NOT {_AMBIGUOUS}) AS accepted_rows,
 count(*) FILTER (WHERE NOT {_ACCEPTED} OR {_AMBIGUOUS}) AS review_rows,
 (SELECT count(DISTINCT pdf_name) FROM tr) AS training_rows FROM d"""

# --- functions on single sentences ---------------------------------------------------------
_FIRST = MENTIONS + ", f AS (SELECT said.*, pre || val || post AS sentence FROM said WHERE slot = 0) "
_PLACE = "CAST(strpos(lower(sentence), alias) - 1 AS INTEGER)"
ORACLES["nearest_keyword"] = _FIRST + (
    f"SELECT k AS o_orderkey, parameter, alias, CASE WHEN alias IS NOT NULL THEN {_PLACE} END AS position FROM f"
)
ORACLES["keyword_occurrences"] = _FIRST + (
    f"SELECT k AS o_orderkey, parameter, alias, {_PLACE} AS position FROM f WHERE alias IS NOT NULL UNION ALL "
    "SELECT k, '氨氮', 'ammonia', CAST(strpos(lower(sentence), 'ammonia') - 1 AS INTEGER) FROM f WHERE t = 12"
)
ORACLES["classify_text"] = _FIRST + (
    f"SELECT k AS o_orderkey, coalesce(category, '{v.OTHER_CATEGORY}') AS category FROM f"
)
# in a sentence no role word comes twice
_ROLE_WORDS = [(a, r) for r, names in v.ROLES.items() for a in names]
ORACLES["role_occurrences"] = _FIRST + (
    f", w(word, which) AS ({values(_ROLE_WORDS)}) SELECT k AS o_orderkey, which AS role, "
    "CAST(strpos(lower(sentence), word) - 1 AS INTEGER) AS position FROM f JOIN w ON contains(lower(sentence), word)"
)
_ANY_ROLE = (
    "CASE WHEN t IN (0, 4, 10) THEN 'influent' WHEN t IN (1, 7, 12) THEN 'effluent' WHEN t = 14 THEN 'removal' "
    "ELSE 'unspecified' END"
)
ORACLES["water_role"] = _FIRST + (
    f"SELECT k AS o_orderkey, {_ANY_ROLE} AS role_anywhere, CASE WHEN t = 12 THEN 'unspecified' ELSE {_ANY_ROLE} END AS role_near FROM f"
)


def _present(alias: str) -> str:
    if not alias.isascii():
        return f"contains(lower(text), {lit(alias)})"
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){alias}($|[^\\p{{L}}\\p{{N}}_])')"


ORACLES["classify_documents"] = (
    "SELECT 'doc_' || doc_id AS pdf_name, CASE "
    + " ".join(f"WHEN {_present(a)} THEN '{v.PARAMETER_CATEGORY[q]}'" for a, q in v.ALIAS_PARAMETER.items()
               if "(" not in a)
    + f" ELSE '{v.OTHER_CATEGORY}' END AS category, CASE "
    + " ".join(f"WHEN contains(lower(text), {lit(a)}) THEN '{r}'" for r, names in v.ROLES.items() for a in names)
    + " ELSE 'unspecified' END AS role FROM documents"
)

_WORDS = [("COD", "COD"), ("Nh3-N", "氨氮"), ("temp", "温度"), ("Dissolved Oxygen", "溶解氧"), ("basin", None), ("温度", "温度")]
ORACLES["keyword_lookup"] = (
    f"WITH w(i, word, parameter) AS ({values([(i, *w) for i, w in enumerate(_WORDS)])}) "
    "SELECT p_partkey, word, parameter FROM part JOIN w ON w.i = p_partkey % 6"
)
_TEXTS = [("12~22", 17.0), ("-5", -5.0), ("abc", None), (" 7.5 ", 7.5), ("1e3", 1000.0), ("1 - 3", 2.0), ("10d", None), ("3－4", 3.5)]
ORACLES["parse_value_range"] = (
    f"WITH w(i, raw, value) AS ({values([(i, *w) for i, w in enumerate(_TEXTS)])}) "
    "SELECT o_orderkey, raw, CAST(value AS DOUBLE) AS value FROM orders JOIN w ON w.i = o_orderkey % 8"
)
_UNITS = [
    ("ug/L", 0.001, "mg/L"), ("kg/m3", 1000.0, "mg/L"), ("m³/h", 24.0, "m³/d"), ("L/day", 0.001, "m³/d"),
    ("days", 24.0, "h"), ("ppb", 0.001, "mg/L"), ("℃", 1.0, "°C"), ("furlong", 1.0, "furlong"),
]
ORACLES["unit_normalize"] = (
    f"WITH w(i, raw_unit, factor, unit) AS ({values([(i, *w) for i, w in enumerate(_UNITS)])}) "
    "SELECT l_orderkey, raw_unit, round(l_quantity * CAST(factor AS DOUBLE), 6) AS value, unit "
    "FROM lineitem JOIN w ON w.i = l_partkey % 8"
)
_CATEGORIES = [
    ("COD", "水质参数"), ("水力负荷", "运行参数"), ("长", "湿地(类型)结构"), ("芦苇", "植物参数"), ("温度", "环境信息"),
    ("unknown", "其他参数"),
]
ORACLES["category_lookup"] = (
    f"WITH w(i, parameter, category) AS ({values([(i, *w) for i, w in enumerate(_CATEGORIES)])}) "
    "SELECT p_partkey, parameter, category FROM part JOIN w ON w.i = p_partkey % 6"
)

_SCORED = [
    (1, "COD", "concentration"), (2, "pH", "unitless"), (3, "水力停留时间", "time"), (4, "温度", "temperature"),
    (5, "长", "length"), (6, "种植密度", "density"), (7, "芦苇", ""),
]
_SCORED_UNITS = [(0, "mg/L", "concentration"), (1, "", ""), (2, "h", "time"), (3, "°C", "temperature"), (4, "m", "length"), (5, "acre", "")]
ORACLES["score_candidates"] = f"""
WITH q(i, parameter, expected) AS ({values(_SCORED)}), u(i, unit, found) AS ({values(_SCORED_UNITS)}),
r AS (SELECT parameter, unit, expected, found, l_partkey % 60 AS distance,
 CASE WHEN l_linenumber = 3 THEN 1980 + l_quantity ELSE l_quantity - 10 END AS value
 FROM lineitem JOIN q ON q.i = l_linenumber JOIN u ON u.i = l_suppkey % 6),
s AS (SELECT *, distance > 30 AS far, CASE WHEN expected = 'unitless' THEN CASE WHEN unit <> '' THEN 1 ELSE 0 END
 WHEN expected <> '' AND unit = '' THEN 2 WHEN expected <> '' AND found <> expected THEN 3
 WHEN unit <> '' AND found = '' THEN 4 ELSE 0 END AS fault,
 unit = '' AND value BETWEEN 1900 AND 2099 AS year, parameter = 'pH' AND value NOT BETWEEN 0 AND 14 AS acid,
 expected <> 'temperature' AND value < 0 AS negative FROM r),
c AS (SELECT *, CASE WHEN year OR acid THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - CASE WHEN far THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
 - [0.0::DOUBLE, 0.45, 0.55, 0.65, 0.2][fault + 1] END - CASE WHEN negative THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM s),
f AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) AS confidence FROM c)
SELECT parameter, unit, value, distance, confidence, CASE WHEN confidence >= 0.7 THEN 'accepted_candidate'
 WHEN confidence >= 0.4 THEN 'review_required' ELSE 'rejected' END AS quality_status,
 concat_ws('; ', CASE WHEN far THEN '{v.REASON_FAR}' END, CASE fault WHEN 1 THEN '{v.REASON_UNITLESS}'
 WHEN 2 THEN '{v.REASON_NO_UNIT}' WHEN 3 THEN '{v.REASON_WRONG_UNIT}' WHEN 4 THEN '{v.REASON_UNKNOWN_UNIT}' END,
 CASE WHEN year THEN '{v.REASON_YEAR}' END, CASE WHEN acid THEN '{v.REASON_PH}' END,
 CASE WHEN negative THEN '{v.REASON_NEGATIVE}' END) AS quality_reason FROM f"""

# --- merge, training rows, audit, cleaning ----------------------------------------------
ORACLES["merge_upsert"] = """
WITH i AS (SELECT *, 'study_' || l_suppkey || '.pdf' AS pdf_name FROM lineitem),
o AS (SELECT pdf_name, count(*) AS a, sum(l_quantity) AS b FROM i WHERE l_linenumber <= 4 OR l_suppkey % 3 <> 0 GROUP BY 1),
n AS (SELECT pdf_name, count(*) AS a, max(l_extendedprice) AS c FROM i WHERE l_linenumber > 4 AND l_suppkey % 3 = 0 GROUP BY 1)
SELECT pdf_name, a, CAST(NULL AS DOUBLE) AS b, c FROM n UNION ALL
SELECT pdf_name, a, b, NULL FROM o WHERE pdf_name NOT IN (SELECT pdf_name FROM n)"""

ORACLES["merge_repeated_keys"] = """
WITH i AS (SELECT *, row_number() OVER () AS place FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber % 2 = 0 AS newer, place, l_quantity AS a, l_extendedprice AS b,
 CASE WHEN l_partkey % 5 <> 0 THEN l_discount END AS c FROM i),
w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY newer DESC, place DESC) AS back FROM r)
SELECT 'study_' || l_orderkey || '.pdf' AS pdf_name, a, CASE WHEN NOT newer THEN b END AS b, CASE WHEN newer THEN c END AS c
FROM w WHERE back = 1"""

ROWS = """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS source_id,
 CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS quantity,
 CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS price,
 CASE WHEN l_orderkey % 5 <> 1 THEN l_discount END AS discount, 5.0::DOUBLE AS constant,
 CASE WHEN l_orderkey % 31 = 0 THEN l_tax END AS sparse, CAST(NULL AS DOUBLE) AS empty,
 CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted_candidate' END AS quality_status,
 CASE WHEN l_linestatus = 'O' THEN 'approved' WHEN l_linenumber = 1 THEN 'confirmed' ELSE 'pending' END AS review_status
 FROM lineitem)
"""
_NUMERIC = ["quantity", "price", "discount", "constant", "sparse", "empty"]
ORACLES["training_csv"] = ROWS + (
    "SELECT CAST(source_id AS BIGINT) AS source_id, quantity, price, discount, constant, sparse, quality_status, "
    "review_status FROM t"
)
_MISSING = "avg(CASE WHEN {0} IS NULL THEN 1.0::DOUBLE ELSE 0 END)"
_RATIO_TEXT = " || ';' || ".join(
    f"'{c}=' || CAST(CAST(round({_MISSING.format(c)}, 6) AS DECIMAL(9,6)) AS VARCHAR)" for c in _NUMERIC
)
_BARE = "(SELECT * EXCLUDE (quality_status, review_status) FROM t)"
ORACLES["audit_report"] = ROWS + f""", g AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM {_BARE})) AS u,
 count(DISTINCT source_id) AS s, {_RATIO_TEXT} AS ratio FROM {_BARE})
SELECT CAST(n AS BIGINT) AS "rows", 7 AS "columns", 6 AS numeric_columns, 'source_id' AS source_column, s AS source_count,
 CAST(n - u AS BIGINT) AS duplicate_rows, 'empty' AS all_missing_columns, 'constant|empty' AS constant_numeric_columns,
 ratio AS missing_ratio, concat_ws('|', CASE WHEN s < 3 THEN '{v.WARN_FEW_SOURCES}' END,
 CASE WHEN n > u THEN '{v.WARN_DUPLICATES[0]}' || (n - u) || '{v.WARN_DUPLICATES[1]}' END,
 '{v.WARN_CONSTANT}constant, empty') AS warnings FROM g"""
ORACLES["audit_missing_ratio"] = ROWS + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round({_MISSING.format(c)}, 9) AS missing_ratio FROM t" for c in _NUMERIC
)
ORACLES["audit_constant_columns"] = ROWS + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) <= 1 AS is_constant FROM t" for c in _NUMERIC
)
ORACLES["audit_duplicates"] = """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_quantity, l_returnflag
 FROM lineitem)) AS BIGINT) AS duplicate_rows FROM lineitem"""
ORACLES["filter_quality"] = ROWS + f"SELECT source_id, quantity, price FROM t WHERE {_ACCEPTED}"
ORACLES["filter_reviewed"] = ROWS + (
    "SELECT source_id, quantity, price FROM t WHERE review_status IN ('approved', 'confirmed')"
)
ORACLES["select_by_missing_ratio"] = ROWS + "SELECT quantity, price, discount, constant FROM t"
ORACLES["drop_all_null_rows"] = ROWS + (
    "SELECT source_id, quantity, discount, sparse FROM t "
    "WHERE quantity IS NOT NULL OR discount IS NOT NULL OR sparse IS NOT NULL"
)
ORACLES["drop_constant_columns"] = ROWS + "SELECT source_id, quantity, price, discount, sparse FROM t"


def _iqr_steps(columns: list[str], k: float, start: str) -> tuple[str, str]:
    """CTEs that filter column by column, and the name of the last one."""
    sql, name = "", start
    for i, c in enumerate(columns):
        low, high = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        sql += (
            f", b{i} AS (SELECT {low} - {k} * ({high} - {low}) AS lo, {high} + {k} * ({high} - {low}) AS hi FROM {name})"
            f", s{i} AS (SELECT {name}.* FROM {name}, b{i} WHERE {c} IS NULL OR {c} BETWEEN lo AND hi)"
        )
        name = f"s{i}"
    return sql, name


_steps, _last = _iqr_steps(["price", "quantity", "discount"], 1.5, "t")
ORACLES["outlier_iqr"] = ROWS + _steps + f" SELECT source_id, price, quantity, discount FROM {_last}"
_bounds = ", ".join(
    f"quantile_cont({c}, 0.25) - 0.3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo{i}, "
    f"quantile_cont({c}, 0.75) + 0.3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi{i}"
    for i, c in enumerate(["price", "quantity", "discount"])
)
ORACLES["outlier_iqr_one_pass"] = ROWS + f", b AS (SELECT {_bounds} FROM t) " + (
    "SELECT source_id, price, quantity, discount FROM t, b WHERE "
    + " AND ".join(f"({c} IS NULL OR {c} BETWEEN lo{i} AND hi{i})" for i, c in enumerate(["price", "quantity", "discount"]))
)
ORACLES["outlier_zscore"] = ROWS + """, a AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM t),
 x AS (SELECT t.* FROM t, a WHERE price IS NULL OR abs((price - m) / s) < 1.5),
 b AS (SELECT avg(quantity) AS m, stddev_pop(quantity) AS s FROM x)
 SELECT source_id, price, quantity, constant FROM x, b WHERE quantity IS NULL OR abs((quantity - m) / s) < 1.5"""
_steps, _last = _iqr_steps(["quantity", "price", "discount", "constant"], 1.5, "kept")
ORACLES["load_dataset"] = ROWS + f""", kept AS (SELECT quantity, price, discount, constant, source_id AS source FROM t
 WHERE {_ACCEPTED} AND review_status IN ('approved', 'confirmed')){_steps}
 SELECT quantity, price, discount, constant, source FROM {_last}"""

# --- designs --------------------------------------------------------------------------------
DESIGNS = """WITH raw AS (SELECT p_partkey AS design_id, p_partkey AS k,
 CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'abc' ELSE CAST(5 + k % 50 AS VARCHAR) END AS "长",
 CASE WHEN k % 11 = 0 THEN '0.05' ELSE (2 + k % 9) || '.5' END AS "宽", CASE WHEN k % 13 = 0 THEN '25' ELSE '1.5' END AS "高",
 CASE k % 5 WHEN 0 THEN '水平潜流' WHEN 1 THEN ' Vertical ' WHEN 2 THEN NULL WHEN 3 THEN 'diagonal' ELSE 'horizontal' END AS flow_type,
 CASE k % 6 WHEN 0 THEN '2.5' WHEN 1 THEN NULL ELSE CAST(1 + k % 8 AS VARCHAR) END AS compartments,
 CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '1.6' ELSE '0.8' END AS water_depth,
 CASE WHEN k % 17 = 0 THEN '1.4' END AS wall_thickness,
 CASE WHEN k % 3 <> 0 THEN (10 + k % 30) || '.3' END AS "水力停留时间",
 CASE WHEN k % 2 = 0 THEN '7.25' ELSE 'site a' END AS note FROM part),
typed AS (SELECT design_id, k, CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 12.5::DOUBLE WHEN 2 THEN NULL
 ELSE CAST(5 + k % 50 AS DOUBLE) END AS "长", CAST("宽" AS DOUBLE) AS "宽", CAST("高" AS DOUBLE) AS "高",
 CASE k % 5 WHEN 0 THEN 'horizontal' WHEN 1 THEN 'vertical' ELSE flow_type END AS flow_type,
 CASE WHEN k % 6 = 0 THEN NULL ELSE CAST(compartments AS INTEGER) END AS compartments,
 CAST(water_depth AS DOUBLE) AS water_depth, CAST(wall_thickness AS DOUBLE) AS wall_thickness,
 CAST("水力停留时间" AS DOUBLE) AS "水力停留时间", CASE WHEN k % 2 = 0 THEN 7.25::DOUBLE END AS note_number,
 CASE WHEN k % 2 = 1 THEN note END AS note_text,
 concat_ws('|', CASE WHEN k % 7 = 2 THEN '长: could not convert string to float: ''abc''' END,
 CASE WHEN k % 6 = 0 THEN 'compartments: compartments 必须是整数' END) AS faults FROM raw),
filled AS (SELECT * REPLACE (coalesce(flow_type, 'horizontal') AS flow_type,
 CASE WHEN k % 6 = 1 THEN 1 ELSE compartments END AS compartments, coalesce(water_depth, 0.6) AS water_depth,
 coalesce(wall_thickness, 0.15) AS wall_thickness), 0.1::DOUBLE AS inlet_diameter, 0.1::DOUBLE AS partition_thickness FROM typed)
"""
_SIZES = ['"长"', '"宽"', '"高"']


def _bounds_of(name: str) -> list[str]:
    spec = v.SPECS[name]
    out = []
    if spec.minimum is not None:
        out.append(f"CASE WHEN \"{name}\" < {spec.minimum} THEN '{name} 不能小于 {spec.minimum} {spec.unit}' END")
    if spec.maximum is not None:
        out.append(f"CASE WHEN \"{name}\" > {spec.maximum} THEN '{name} 不能大于 {spec.maximum} {spec.unit}' END")
    return out


def _messages(required: list[str], columns: list[str]) -> str:
    parts = ["nullif(faults, '')"]
    for c in columns:
        if c == "flow_type":
            parts.append(
                "CASE WHEN flow_type NOT IN ('horizontal', 'vertical') THEN 'flow_type 必须是 horizontal, vertical 之一' END"
            )
        else:
            parts += _bounds_of(c)
    parts += [f"CASE WHEN \"{c}\" IS NULL THEN '缺少必填参数: {c}' END" for c in required]
    parts += [
        f"CASE WHEN water_depth >= \"高\" THEN '{v.MSG_WATER_DEPTH}' END",
        f"CASE WHEN 2 * wall_thickness >= \"长\" THEN '{v.MSG_WALL_LENGTH}' END",
        f"CASE WHEN 2 * wall_thickness >= \"宽\" THEN '{v.MSG_WALL_WIDTH}' END",
    ]
    return "concat_ws('|', " + ", ".join(parts) + ")"


_GIVEN = ["长", "宽", "高", "flow_type", "compartments", "water_depth", "wall_thickness", "水力停留时间"]
_GIVEN_SQL = ", ".join(f'"{c}"' for c in _GIVEN)
ORACLES["coerce_params"] = DESIGNS + (
    f"SELECT design_id, {_GIVEN_SQL}, note_number, note_text, faults AS errors FROM typed"
)
_RAW_DEFAULTS = {
    "flow_type": "'horizontal'", "compartments": "'1'", "water_depth": "'0.6'", "wall_thickness": "'0.15'",
}
ORACLES["apply_defaults"] = DESIGNS + "SELECT design_id, " + ", ".join(
    f'coalesce("{c}", {_RAW_DEFAULTS[c]}) AS "{c}"' if c in _RAW_DEFAULTS
    else (f'0.1::DOUBLE AS "{c}"' if c in ("inlet_diameter", "partition_thickness") else f'"{c}"')
    for c in v.DESIGN_FIELDS
) + " FROM raw"
_VALIDATED = DESIGNS + ", checked AS (SELECT *, {messages} AS errors FROM {source}) "
ORACLES["validate_params"] = _VALIDATED.format(
    messages=_messages(v.DESIGN_FIELDS, _GIVEN),
    source="(SELECT *, NULL::DOUBLE AS inlet_diameter, NULL::DOUBLE AS partition_thickness FROM typed)",
) + f"SELECT design_id, {_GIVEN_SQL}, note_number, note_text, errors, errors = '' AS is_valid FROM checked"
# defaulted columns the table lacked come last
_PREPARED = _VALIDATED.format(
    messages=_messages(v.DESIGN_FIELDS, [*_GIVEN, "inlet_diameter", "partition_thickness"]), source="filled"
)
ORACLES["prepare_designs"] = _PREPARED + (
    f"SELECT design_id, {_GIVEN_SQL}, inlet_diameter, partition_thickness, note_number, note_text, errors, "
    "errors = '' AS is_valid FROM checked"
)
ORACLES["select_features"] = DESIGNS + 'SELECT design_id, "长", CAST(NULL AS DOUBLE) AS COD FROM raw'
_NAMES = [(i, n, s.unit, f"{n} ({s.unit})" if s.unit else n) for i, (n, s) in enumerate(v.SPECS.items())]
_NAMES.append((len(_NAMES), "unknown", None, "unknown"))
ORACLES["display_names"] = (
    f"WITH w(i, name, unit, display_name) AS ({values(_NAMES)}) "
    f"SELECT p_partkey, name, unit, display_name FROM part JOIN w ON w.i = p_partkey % {len(_NAMES)}"
)
ORACLES["design_brief"] = _PREPARED + """SELECT design_id, '请绘制一个人工湿地工程平面图，尺寸约为 ' || printf('%.1f', "长") || 'm x '
 || printf('%.1f', "宽") || 'm x ' || printf('%.1f', "高") || 'm，流型为 ' || flow_type || '，共有 ' || compartments || ' 个隔间，'
 || CASE WHEN "水力停留时间" IS NULL THEN '' ELSE '水力停留时间约 ' || printf('%.1f', "水力停留时间") || ' 小时，' END
 || '请以工程制图风格展示进水、出水、隔断和主要流向。图中应标注隔间编号、水流方向和进水口位置。' AS brief FROM checked WHERE errors = ''"""
ORACLES["partition_layout"] = _PREPARED + """SELECT design_id, CAST(n AS INTEGER) AS wall_no,
 round(n * ("长" - 2 * wall_thickness) / compartments + wall_thickness - partition_thickness / 2, 6) AS wall_x,
 round(CASE WHEN n % 2 = 0 THEN wall_thickness ELSE "宽" - 2 * wall_thickness END, 6) AS opening_y,
 round(0.35::DOUBLE * water_depth, 6) AS opening_height
 FROM (SELECT *, unnest(range(1, compartments)) AS n FROM checked WHERE errors = '')"""

# --- splits, metrics, imputation ------------------------------------------------------------


def _hash(key: str) -> str:
    return f"('0x' || substr(md5('42|' || {key}), 1, 13))::BIGINT"


ORACLES["group_folds"] = f"""
WITH RECURSIVE sizes AS (SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1),
tot AS (SELECT sum(n)::DOUBLE AS total FROM sizes),
heavy AS (SELECT s, n, row_number() OVER (ORDER BY n DESC, s DESC) AS i FROM sizes, tot WHERE n > total / 500),
deal AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS s, NULL::INTEGER AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
 SELECT h.i, h.s, (list_position(d.loads, list_min(d.loads)) - 1)::INTEGER, list_transform(d.loads,
 lambda x, j: CASE WHEN j = list_position(d.loads, list_min(d.loads)) THEN x + h.n ELSE x END)
 FROM deal d JOIN heavy h ON h.i = d.i + 1),
room AS (SELECT list_transform(loads, lambda x: greatest(total / 5 - x, 0)) AS r FROM deal, tot ORDER BY i DESC LIMIT 1),
light AS (SELECT s, n, {_hash('s')}::DOUBLE / 4503599627370496 * list_sum(r) AS place, r FROM sizes, tot, room WHERE n <= total / 500)
SELECT sizes.s AS l_suppkey, deal.fold AS fold, sizes.n AS "rows" FROM deal JOIN sizes ON sizes.s = deal.s UNION ALL
SELECT s, CASE WHEN place < r[1] THEN 0 WHEN place < r[1] + r[2] THEN 1 WHEN place < r[1] + r[2] + r[3] THEN 2
 WHEN place < r[1] + r[2] + r[3] + r[4] THEN 3 ELSE 4 END::INTEGER, n FROM light"""


def _folds(table: str, key: str) -> str:
    """Five parts of equal size in the order of the hash; equal keys share the later part."""
    later = " + ".join(f"(upto > {i} * total // 5)::INTEGER" for i in range(1, 5))
    return f"""(SELECT *, {later} AS fold FROM (
 SELECT *, count(*) OVER (ORDER BY {_hash(key)}) AS upto, count(*) OVER () AS total FROM {table}))"""


ORACLES["hash_folds"] = f"SELECT o_orderkey, fold FROM {_folds('orders', 'o_orderkey')}"
ORACLES["group_holdout"] = f"""
WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY {_hash('l_suppkey')}, l_suppkey) AS i, count(*) OVER () AS g FROM s)
SELECT l_suppkey, CASE WHEN i <= ceil(0.2 * g) THEN 'test' ELSE 'train' END AS part, n AS "rows" FROM r"""
_CLOSED = """WITH c AS (SELECT l_orderkey, l_extendedprice AS y, l_quantity * 2000 * (1 - l_discount) AS p FROM lineitem),
"""
ORACLES["regression_metrics"] = _CLOSED + """g AS (SELECT avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae,
 avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape, quantile_cont(abs(y - p), 0.5) AS med, var_pop(y) AS s FROM c)
SELECT round(mse, 1) AS "MSE", round(sqrt(mse), 4) AS "RMSE", round(mae, 4) AS "MAE", round(mape, 8) AS "MAPE",
 round(med, 4) AS "MedAE", round(1 - mse / s, 8) AS "R2" FROM g"""
ORACLES["baseline_rmse"] = _CLOSED + f"""f AS (SELECT y, fold FROM {_folds('c', 'l_orderkey')}),
med AS (SELECT k.fold, quantile_cont(f.y, 0.5) AS m FROM (SELECT DISTINCT fold FROM f) k JOIN f ON f.fold <> k.fold GROUP BY 1)
SELECT f.fold, round(sqrt(avg((y - m) * (y - m))), 4) AS rmse FROM f JOIN med USING (fold) GROUP BY 1"""
ORACLES["impute_initial"] = ROWS + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, "
    f"round((SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1), 6) AS most_frequent, "
    "0.0::DOUBLE AS constant FROM t"
    for c in ("quantity", "discount", "sparse")
)
ORACLES["impute_mask"] = f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_custkey % 7 <> 0),
r AS (SELECT *, row_number() OVER (ORDER BY {_hash('o_orderkey')}) AS i, count(*) OVER () AS n FROM o)
SELECT o_orderkey, price FROM r WHERE i <= greatest(1, round_even(n * 0.2, 0))"""

# two predictors: the linear system and the trace of its inverse are written out
ORACLES["bayesian_ridge"] = ROWS.replace("WITH t AS", "WITH RECURSIVE t AS", 1) + """,
x AS (SELECT quantity AS a, discount AS b, price AS y FROM t WHERE quantity IS NOT NULL AND discount IS NOT NULL AND price IS NOT NULL),
m AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb,
 covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ya, covar_pop(b, y) * count(*) AS yb, var_pop(y) * count(*) AS yy FROM x),
it AS (
 SELECT 0 AS r, 1 / (yy / n + 2.220446049250313e-16) AS noise, 1.0::DOUBLE AS weight, NULL::DOUBLE AS ca, NULL::DOUBLE AS cb, false AS done FROM m
 UNION ALL
 SELECT r + 1, (n - g + 2e-6) / (greatest(yy - 2 * (ca1 * ya + cb1 * yb) + ca1 * ca1 * aa + 2 * ca1 * cb1 * ab + cb1 * cb1 * bb, 0) + 2e-6),
  (g + 2e-6) / (ca1 * ca1 + cb1 * cb1 + 2e-6), ca1, cb1, coalesce(abs(ca1 - ca) + abs(cb1 - cb) < 1e-3, false)
 FROM (SELECT *, 2 - weight * (p + q) / (p * q - s * s) AS g, noise * (q * ya - s * yb) / (p * q - s * s) AS ca1,
   noise * (p * yb - s * ya) / (p * q - s * s) AS cb1
  FROM (SELECT it.*, m.*, noise * aa + weight AS p, noise * bb + weight AS q, noise * ab AS s FROM it, m WHERE NOT done AND r < 300))),
e AS (SELECT *, noise * aa + weight AS p, noise * bb + weight AS q, noise * ab AS s FROM it, m ORDER BY r DESC LIMIT 1),
f AS (SELECT *, noise * (q * ya - s * yb) / (p * q - s * s) AS fa, noise * (p * yb - s * ya) / (p * q - s * s) AS fb FROM e)
SELECT n::BIGINT AS "rows", round(fa, 4) AS quantity, round(fb, 2) AS discount, round(my - fa * ma - fb * mb, 2) AS intercept,
 round(1 / sqrt(noise), 2) AS noise, round(1 / sqrt(weight), 2) AS spread, r::BIGINT AS rounds FROM f"""
