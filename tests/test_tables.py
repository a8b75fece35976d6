import pytest
from paramill import vocabulary as v
from paramill.operators import audit, cleaning, extraction, merge, tables
from paramill.plans.extraction_job import extract_tables
from pyspark.sql import functions as F

PAGES = "pdf_name string, page int, text string"
TEXT = "COD was 40 mg/L. Influent TN was 20 mg/L. HRT was 5 mg/L."


def test_ambiguous_and_rejected_stay_out_of_training(spark):
    detail = extraction.extract(spark.createDataFrame([("paper.pdf", 1, TEXT), ("none.pdf", 1, "HRT 5 mg/L")], PAGES))
    out = tables.build_tables(tables.clean_detail(detail))
    training = out["training"].collect()
    assert out["training"].columns == ["pdf_name", "总氮__influent"]
    assert [tuple(r) for r in training] == [("paper.pdf", 20.0)]
    assert out["review"].count() == 3
    assert out["quality"].agg(F.sum(v.QUALITY_COUNT)).first()[0] == out["detail"].count() == 4


def test_job_writes_all_tables_and_counts(spark, tmp_path):
    pages = spark.createDataFrame([("a.pdf", 1, TEXT), ("a.pdf", 1, TEXT), ("b.pdf", 2, "Effluent COD 3 mg/L")], PAGES)
    old = spark.createDataFrame([("a.pdf", 1.0), ("z.pdf", 2.0)], "pdf_name string, extra double")
    counts = extract_tables(pages, f"{tmp_path}/out", f"{tmp_path}/csv", old)
    assert counts == {"detail_rows": 4, "accepted_rows": 2, "review_rows": 2, "training_rows": 3}
    training = {r["pdf_name"]: r for r in spark.read.parquet(f"{tmp_path}/out/training").collect()}
    assert training["z.pdf"]["extra"] == 2.0 and training["a.pdf"]["extra"] is None
    assert training["b.pdf"]["COD__effluent"] == 3.0
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 3
    with pytest.raises(ValueError):
        extract_tables(pages.limit(0), f"{tmp_path}/empty")


def test_merge_keeps_last_as_a_whole(spark):
    old = spark.createDataFrame([("k", 1, 2, 1), ("k", 9, 9, 2), ("o", 5, 6, 3), (None, 7, 7, 4)], "pdf_name string, a int, b int, seq int")
    new = spark.createDataFrame([("k", 3, 4, 5), (None, 8, 8, 6)], "pdf_name string, a int, c int, seq int")
    rows = {r["pdf_name"]: (r["a"], r["b"], r["c"]) for r in merge.merge_training(old, new, sequence="seq").collect()}
    assert rows == {"k": (3, None, 4), "o": (5, 6, None), None: (8, None, 8)}
    doubled = new.unionByName(new)
    assert merge.merge_training(old.limit(0), doubled).count() == 4
    assert merge.merge_training(None, doubled).count() == 4
    last = merge.merge_training(old, new.limit(0), sequence="seq").where("pdf_name = 'k'").first()
    assert last["a"] == 9


def test_audit(spark):
    df = spark.createDataFrame(
        [("a.pdf", 1.0, 5.0, None), ("a.pdf", 1.0, 5.0, None), ("b.pdf", float("nan"), 5.0, None)],
        "pdf_name string, x double, constant double, gone string",
    )
    r = audit.audit(df).first().asDict()
    assert (r["rows"], r["columns"], r["numeric_columns"], r["source_column"], r["source_count"]) == (3, 4, 2, "pdf_name", 2)
    assert r["duplicate_rows"] == 1
    assert r["constant_numeric_columns"] == ["x", "constant"] and r["all_missing_columns"] == ["gone"]
    assert r["missing_ratio"]["x"] == pytest.approx(1 / 3)
    assert r["warnings"] == [
        v.WARN_FEW_ROWS, v.WARN_FEW_SOURCES, "存在 1 行完全重复记录", "存在常量数值列: x, constant",
    ]
    bare = audit.audit(df.select("x")).first()
    assert bare["source_count"] == 0 and v.WARN_NO_SOURCE in bare["warnings"]
    with pytest.raises(ValueError):
        audit.find_source_column(["a"], "b")


def test_dataset_filters(spark):
    rows = [(1, 2, "accepted_candidate", "approved"), (3, 4, "accepted_candidate", "pending"), (5, 6, "rejected", "approved")]
    df = spark.createDataFrame(rows, "x int, y int, quality_status string, review_status string")
    data = cleaning.load_dataset(df, require_reviewed=True)
    assert data.features == ["x", "y"] and data.frame.count() == 1 and data.source is None
    assert cleaning.load_dataset(df).frame.count() == 2
    with pytest.raises(ValueError):
        cleaning.load_dataset(df.where("review_status = 'pending'"), require_reviewed=True)


def test_dataset_source_and_columns(spark):
    rows = [(i, float(i), None if i else 1.0, None) for i in range(10)]
    df = spark.createDataFrame(rows, "lab int, x double, rare double, gone double")
    data = cleaning.load_dataset(df, source_column="lab")
    assert data.features == ["x"] and data.source == "lab" and data.frame.columns == ["x", "_source"]
    assert cleaning.load_dataset(df, source_column="lab", keep_source_feature=True).features == ["lab", "x"]
    assert cleaning.load_dataset(df, min_non_na_ratio=0.1).features == ["lab", "x", "rare"]
    with pytest.raises(ValueError, match="未找到"):
        cleaning.prepare_supervised(data, "rare")
    with pytest.raises(ValueError, match="没有可用"):
        cleaning.prepare_supervised(data, "x")


def test_outliers(spark):
    df = spark.createDataFrame([(float(i), float(i % 5)) for i in range(20)] + [(500.0, 2.0), (None, 100.0)], "x double, y double")
    left = cleaning.remove_outliers(df, "iqr", 1.5)
    assert left.count() == 20 and left.agg(F.max("x")).first()[0] == 19.0
    assert cleaning.remove_outliers(df, "zscore", 3.0).count() == 20
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (None, 3.0)], "c double, z double")
    assert cleaning.remove_outliers(flat, "zscore", 3.0, columns=["c"]).count() == 1
    assert cleaning.drop_constant_columns(flat).columns == ["z"]
    assert cleaning.drop_all_null_rows(df.where("x is null").drop("y"), ["x"]).count() == 0


def test_fingerprints_count_what_grouping_counts(spark):
    import datetime
    import decimal

    kinds = "a double, b string, c string, d timestamp, e binary, f array<int>, g decimal(10,2), h boolean"
    when = datetime.datetime(2024, 10, 27, 2, 30)
    row = (1.5, "x", "y", when, b"q", [1, None], decimal.Decimal("1.50"), True)
    rows = [row, row, (None,) * 8, (None,) * 8, (0.0, "", None, *row[3:]), (-0.0, "", None, *row[3:]), (0.0, None, "", *row[3:])]
    rows += [(1.5, "x:1", "y", *row[3:]), (1.5, "x", ":1y", *row[3:]), (float("nan"), *row[1:]), (None, *row[1:]), (1.5, "x", "y", when, b"Q", [1], *row[6:])]
    df = spark.createDataFrame(rows, kinds)
    from paramill.operators.audit import duplicate_rows, nan_to_null

    clean = nan_to_null(df)
    assert duplicate_rows(df).first()[0] == clean.count() - clean.distinct().count() == 4
    assert duplicate_rows(df.limit(0)).first()[0] == 0
