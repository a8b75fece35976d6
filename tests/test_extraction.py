import random
import re

import pytest
from paramill import vocabulary as v
from paramill.functions import scoring, text
from paramill.operators import extraction, tables
from paramill.plans import registered
from pyspark.sql import functions as F

PAGES = "pdf_name string, page int, text string"


def detail(spark, pages):
    df = extraction.extract(spark.createDataFrame(pages, PAGES))
    return sorted(tuple(r) for r in df.collect())


def test_roles_and_ids(spark):
    rows = detail(spark, [("paper.pdf", 3, "Influent COD was 200 mg/L and effluent COD was 30 mg/L.")])
    assert [r[3] for r in rows] == ["influent", "effluent"]
    assert [r[0] for r in rows] == ["paper.pdf:p3:1", "paper.pdf:p3:2"]
    assert {r[4] for r in rows} == {"pending"} and {r[5] for r in rows} == {"accepted_candidate"}


def test_composite_unit(spark):
    (row,) = detail(spark, [("a", 1, "The hydraulic loading rate was 0.35 m³/(m²·d).")])
    assert (row[9], row[12], row[5]) == ("水力负荷", "m³/(m²·d)", "accepted_candidate")


GOOD, CHECK, BAD = "accepted_candidate", "review_required", "rejected"
# text -> records (role, status, score, reason, parameter, spelling, value, unit, value and unit as written)
KNOWN = {
    "出水COD为30 mg/L": [],
    "depth 1-3 m": [
        ("not_applicable", CHECK, 0.45, v.REASON_NO_UNIT, "高", "depth", 1.0, "", "1", ""),
        ("not_applicable", GOOD, 1.0, "", "高", "depth", 3.0, "m", "3", "m"),
    ],
    "depth 1 - 3 m": [("not_applicable", GOOD, 1.0, "", "高", "depth", 2.0, "m", "1 - 3", "m")],
    "COD 2020": [("unspecified", BAD, 0.0, f"{v.REASON_NO_UNIT}; {v.REASON_YEAR}", "COD", "cod", 2020.0, "", "2020", "")],
    "COD 0.2015": [("unspecified", BAD, 0.0, f"{v.REASON_NO_UNIT}; {v.REASON_YEAR}", "COD", "cod", 0.2015, "", "0.2015", "")],
    "pH 15": [("unspecified", BAD, 0.0, v.REASON_PH, "pH", "ph", 15.0, "", "15", "")],
    "pH 7.2": [("unspecified", GOOD, 1.0, "", "pH", "ph", 7.2, "", "7.2", "")],
    "temperature -5 °C": [("not_applicable", GOOD, 1.0, "", "温度", "temperature", -5.0, "°C", "-5", "°C")],
    "length -5 m": [("not_applicable", CHECK, 0.5, v.REASON_NEGATIVE, "长", "length", -5.0, "m", "-5", "m")],
    "HRT 2 d": [("not_applicable", GOOD, 1.0, "", "水力停留时间", "hrt", 48.0, "h", "2", "d")],
    "total\nnitrogen 12～14 mg/L": [("unspecified", GOOD, 1.0, "", "总氮", "total nitrogen", 13.0, "mg/L", "12～14", "mg/L")],
    "COD 30 μg/L": [("unspecified", BAD, 0.35, v.REASON_WRONG_UNIT, "COD", "cod", 30.0, "μg/L", "30", "μg/L")],
    "TN 5 MG/L": [("unspecified", GOOD, 1.0, "", "总氮", "tn", 5.0, "MG/L", "5", "MG/L")],
    "Influent COD was 200 mg/L": [("influent", GOOD, 1.0, "", "COD", "cod", 200.0, "mg/L", "200", "mg/L")],
    "effluent TN was 4 mg/L": [("effluent", GOOD, 1.0, "", "总氮", "tn", 4.0, "mg/L", "4", "mg/L")],
    "xCOD 5 mg/L decod 5 mg/L": [],
    "no numbers here": [],
    "COD": [],
    "5": [],
    "": [],
}
#: Longer than a keyword reaches, and free of numbers, spellings and roles.
APART = ". " + "lorem ipsum dolor sit amet " * 5 + ". "


def told(row):
    return (row[2], row[3], row[5], round(row[6], 6), row[7], *row[9:15])


def test_known_records(spark):
    texts = list(KNOWN)
    rows = detail(spark, [("known.pdf", i + 1, t) for i, t in enumerate(texts)])
    assert sorted(map(told, rows)) == sorted((i + 1, *r) for i, t in enumerate(texts) for r in KNOWN[t])


def test_pages_composed_of_known_texts(spark):
    rng = random.Random(7)
    texts = list(KNOWN)
    chosen = [[rng.choice(texts) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    rows = detail(spark, [("composed", i + 1, APART.join(c)) for i, c in enumerate(chosen)])
    want = [(i + 1, *r) for i, c in enumerate(chosen) for t in c for r in KNOWN[t]]
    assert len(want) > 500 and sorted(map(told, rows)) == sorted(want)
    # ids run through the document in the order of its text
    by_number = sorted(rows, key=lambda r: int(r[0].rsplit(":", 1)[1]))
    assert [int(r[0].rsplit(":", 1)[1]) for r in by_number] == list(range(1, len(want) + 1))
    assert [told(r) for r in by_number] == want


@pytest.mark.parametrize(
    ("context", "at", "found"),
    [("cod was tn", 4, ("COD", "cod", 0)), ("x was tn", 2, ("总氮", "tn", 6)), ("cod " + "x " * 30, 50, ("COD", "cod", 0)),
     ("cod " + "x " * 30, 51, None), ("x was y", 2, None), ("decod xtn", 3, None)],
)
def test_nearest_keyword(one, context, at, found):
    got = one(text.nearest_keyword(F.col("c"), F.col("at")), c=context, at=at)
    assert (tuple(got) if got else None) == found


@pytest.mark.parametrize(
    ("context", "at", "role"),
    [("influent was 5. effluent", 13, "influent"), ("influent. effluent was 5", 23, "effluent"), ("it was 5. effluent", 7, "unspecified"),
     ("influent" + " x" * 14, 35, "influent"), ("influent" + " x" * 15, 36, "unspecified")],
)
def test_nearest_role(one, context, at, role):
    assert one(text.water_role(F.col("c"), F.col("at")), c=context, at=at) == role


def test_overlapping_spelling(one):
    found = one(text.keyword_occurrences(F.col("c")), c="nh3-nh3-n")
    assert [(o["name"], o["position"]) for o in found] == [("nh3-n", 4)]


def test_long_page_is_whole(spark):
    page = "COD was 5 mg/L, " * 3000
    df = extraction.match_records(spark.createDataFrame([("long", 1, page)], PAGES))
    assert df.count() == 3000
    offsets = extraction.mention_offsets(spark.createDataFrame([("long", 1, page)], PAGES))
    last = offsets.orderBy(F.desc("mention")).first()
    assert (last["mention"], last["start"], last["end"]) == (2999, 16 * 2999 + 8, 16 * 2999 + 14)


def test_numbering_runs_across_blocks_of_pages(spark):
    step = 1 << extraction.PAGE_BLOCK_BITS
    pages = [("big", 1 + i * step // 2, "COD 1 mg/L. " * (i % 4)) for i in range(20)] + [("other", 5, "TN 2 mg/L")]
    counts = [(p, c.count("COD")) for _, p, c in pages[:-1]]
    owners = [p for p, n in counts for _ in range(n)]
    ids = [f"big:p{p}:{i}" for i, p in enumerate(owners, 1)] + ["other:p5:1"]
    assert sorted(r[0] for r in detail(spark, pages)) == sorted(ids)


def test_repeated_page_keeps_its_ids(spark):
    pages = [("a", 1, "COD 1 mg/L, TN 2 mg/L"), ("a", 1, "COD 1 mg/L, TN 2 mg/L"), ("a", 2, "TP 3 mg/L")]
    rows = detail(spark, pages)
    assert sorted({r[0] for r in rows}) == ["a:p1:1", "a:p1:2", "a:p2:3"]
    assert len(rows) == 5 and len(set(rows)) == 3


@pytest.mark.parametrize(
    ("raw", "value"),
    [("1~3", 2.0), ("-5", -5.0), (" 7.5　", 7.5), ("1e3", 1000.0), ("1_000", 1000.0), ("10d", None), ("abc", None),
     ("", None), ("1 - 4", 2.5), (".5", 0.5), ("5.", 5.0), ("+2", 2.0), ("１２", 12.0), ("1__0", None)],
)
def test_parse_value(one, raw, value):
    assert one(scoring.parse_value(F.col("x")), x=raw) == value


@pytest.mark.parametrize(
    ("value", "unit", "out"),
    [(1000.0, "ug/L", (1.0, "mg/L")), (2.0, "d", (48.0, "h")), (2.0, "m³/h", (48.0, "m³/d")), (2.0, "", (2.0, "")),
     (3.0, "MG/L", (3.0, "MG/L"))],
)
def test_normalize_unit(one, value, unit, out):
    assert tuple(one(scoring.normalize_unit(F.col("v"), F.col("u")), v=value, u=unit)) == out


@pytest.mark.parametrize(
    ("case", "points", "status", "reason"),
    [(("COD", 2020.0, "", 5), 0.0, BAD, f"{v.REASON_NO_UNIT}; {v.REASON_YEAR}"),
     (("水力停留时间", 5.0, "mg/L", 4), 0.35, BAD, v.REASON_WRONG_UNIT),
     (("pH", 7.0, "", 31), 0.75, GOOD, v.REASON_FAR),
     (("pH", 7.0, "h", 1), 0.55, CHECK, v.REASON_UNITLESS),
     (("芦苇", 3.0, "acre", 2), 0.8, GOOD, v.REASON_UNKNOWN_UNIT),
     (("芦苇", 3.0, "", 2), 1.0, GOOD, ""),
     (("温度", -5.0, "°C", 2), 1.0, GOOD, ""),
     (("长", -5.0, "m", 2), 0.5, CHECK, v.REASON_NEGATIVE),
     (("COD", 12345678.1999, "", 2), 0.0, BAD, f"{v.REASON_NO_UNIT}; {v.REASON_YEAR}"),
     (("COD", 123456.5, "", 2), 0.45, CHECK, v.REASON_NO_UNIT)],
)
def test_score(one, case, points, status, reason):
    parameter, value, unit, distance = case
    got = one(scoring.assess(F.col("p"), F.col("x"), F.col("u"), F.col("d")), p=parameter, x=value, u=unit, d=distance)
    assert tuple(got) == (pytest.approx(points), status, reason)


def test_words_and_categories(one):
    assert one(text.water_role(F.col("c")), c="Influent COD was 200 mg/L") == "influent"
    assert one(text.water_role(F.col("c")), c="nothing") == "unspecified"
    assert one(text.normalize_keyword(F.col("c")), c="Dissolved Oxygen") == "溶解氧"
    assert one(text.normalize_keyword(F.col("c")), c="Temperature") == "温度"
    assert one(text.classify_text(F.col("c")), c="reed beds in a warm season") == "植物参数"
    assert one(text.classify_text(F.col("c")), c="nothing") == "其他参数"
    assert one(text.category_of(F.col("c")), c="nothing") == "其他参数"


def test_copies_blanks_and_long_page_numbers(spark):
    kinds = "pdf_name string, page long, text string"
    far = 5_000_000_000
    rows = [("a.pdf", far + i, f"Influent COD was {i + 1} mg/L. Effluent COD was {i + 2} mg/L.") for i in range(3)]
    rows += [rows[1]] * 3 + [("a.pdf", -9000, "Influent COD was 9 mg/L."), ("a.pdf", 1, None), ("b.pdf", None, "Influent TN was 4 mg/L.")]
    rows += [(None, 2, "Influent TN was 5 mg/L."), (None, 2, "Influent TN was 5 mg/L."), ("c.pdf", 1, "HRT was 2 d."), ("c.pdf", 1, "HRT was 3 d.")]
    df = spark.createDataFrame(rows, kinds)
    want = ["a.pdf:p-9000:1", *[f"a.pdf:p{far + i // 2}:{i + 2}" for i in range(6)], "b.pdf:p:1", ":p2:1", "c.pdf:p1:1", "c.pdf:p1:2"]
    assert sorted(r.record_id for r in extraction.extract(df, keep_copies=False).collect()) == sorted(want)
    assert extraction.extract(df).count() == len(want) + 7 and extraction.extract(df.limit(0)).count() == 0


def test_records_are_dealt_once(spark, folder):
    from paramill.plans.sample_inputs import listed_pages

    records = extraction.match_records(listed_pages(spark, folder))
    plan = records.repartition("pdf_name", "page").distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pdf_name") == 1 and "Exchange hashpartitioning(pdf_name" in plan


def test_pages_are_dealt_to_tasks_by_rows(spark, tmp_path):
    from paramill.plans import sample_inputs

    rows = spark.range(600_001).selectExpr("id AS o_orderkey", "id AS o_custkey", "1.5D AS o_totalprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert sample_inputs.report_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 13


def test_rows_are_dropped_without_a_filter_below_the_scan(spark, folder):
    # a filter would go below the exchange that deals pages to tasks, or compute scores and roles twice
    for name in ("review_table", "quality_report", "extract_summary", "training_pivot", "extract_detail", "extract_listed_twice", "scan_number_units"):
        plan = registered.REGISTRY[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter")]
        assert not [line for line in filters if "RLIKE" in line or "element_at" in line], name


def test_pages_and_records_that_are_dropped(spark):
    pages = [("a", 1, "no numbers"), ("a", 2, None), ("a", 3, ""), ("a", 4, "COD was 2020. Influent COD was 30 mg/L. COD was 7 mg/L"), ("a", 4, "COD was 2020.")]
    records = extraction.match_records(spark.createDataFrame(pages, PAGES))
    assert sorted(r.raw_value for r in tables.clean_detail(records).collect()) == ["2020", "2020", "30", "7"]
    shown = tables.clean_detail(tables.review_table(records), ["parameter", "value", "quality_status", "water_role", "category"]).collect()
    assert sorted(r.value for r in shown) == [7.0, 2020.0]


def test_classes_of_overlapping_spellings_in_one_pass(spark):
    """Against a search for every spelling on its own."""
    rng = random.Random(3)
    names = list(v.ALIAS_PARAMETER)
    words = [*names, *[n[:-1] for n in names], *" ".join(names).split(), "x", "²", "_", "-", "5", "。"]
    texts = ["".join(rng.choice(words).upper() + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(0, 5))) for _ in range(3000)] + names
    texts += ["horizontal flow rate", "water temperature", "canna indica", "填料类型(结构)", "水温度", "cod_", "a\ndo\n", None, ""]

    def stands(alias, text):
        edge = r"[^\W_]|_|[²³¹½]"
        at = -1
        while (at := text.find(alias, at + 1)) >= 0:
            if not alias.isascii() or not (re.match(edge, text[at - 1 : at]) or re.match(edge, text[at + len(alias) :])):
                return True
        return False

    def category(t):
        first = next((a for a in names if stands(a, (t or "").lower())), None)
        return v.PARAMETER_CATEGORY[v.ALIAS_PARAMETER[first]] if first else v.OTHER_CATEGORY

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.classify_text(F.col("t")).alias("c"))
    rows = df.collect()
    assert [(r.t, r.c) for r in rows if r.c != category(r.t)] == [] and len({r.c for r in rows}) == len(v.CATEGORIES) + 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("regexp_extract_all(") == 1
