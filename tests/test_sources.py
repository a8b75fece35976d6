import hashlib

import pytest
from paramill import session
from paramill.sources import pages, training
from paramill.streaming.incremental import apply_batch, current_training, extract_stream

PAGES = "pdf_name string, page int, text string"


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("first\nCOD 1 mg/L\fsecond", encoding="utf-8")
    (tmp_path / "b.PDF").write_text("only", encoding="utf-8")
    rows = pages.pages_from_text(spark, str(tmp_path), "*.{pdf,PDF}").collect()
    assert sorted(tuple(r) for r in rows) == [("a.pdf", 1, "first\nCOD 1 mg/L"), ("a.pdf", 2, "second"), ("b.PDF", 1, "only")]
    with pytest.raises(FileNotFoundError):
        pages.pages_from_text(spark, f"{tmp_path}/missing")
    with pytest.raises(FileNotFoundError):
        pages.pages_from_text(spark, str(tmp_path), "*.txt")


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Name,x,y,z\na,1,NA,10d\nb,,2.5,3\nc,nan,1e2,4\n", encoding="utf-8")
    df = training.read_training_csv(spark, str(path))
    assert dict(df.dtypes) == {"Name": "string", "x": "double", "y": "double", "z": "string"}
    assert [tuple(r) for r in df.orderBy("Name").collect()] == [("a", 1.0, None, "10d"), ("b", None, 2.5, "3"), ("c", None, 100.0, "4")]
    assert training.read_training_csv(spark, str(path), "Name string, z int").dtypes == [("Name", "string"), ("z", "int")]
    assert training.read_existing_training(spark, str(path), "csv").columns[0] == "pdf_name"
    with pytest.warns(UserWarning):
        assert training.read_existing_training(spark, f"{tmp_path}/missing") is None
    assert training.file_hashes(spark, str(path)).first()["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()


def test_file_hashes_by_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "WHOLE_FILE", 1000)
    contents = {
        "empty": b"", "small": b"abc", "limit": b"x" * 1000, "one more": b"x" * 1001,
        "exact pieces": bytes(range(256)) * 8192, "not quite %41 ü": b"\x00\xff\n" * 1_000_001,
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    rows = training.file_hashes(spark, str(tmp_path)).collect()
    del contents["empty"]  # Spark's file scan passes over empty files
    assert {r["bytes"] for r in rows} == {len(c) for c in contents.values()} and len(rows) == len(contents)
    assert sorted(r["sha256"] for r in rows) == sorted(hashlib.sha256(c).hexdigest() for c in contents.values())


def test_a_file_above_the_row_limit(spark, tmp_path):
    """Spark refuses such a file as one value; a sparse one takes no disk."""
    path, size = tmp_path / "large", (2 << 30) + 5
    with path.open("wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for _ in range(2 << 10):
        digest.update(bytes(1 << 20))
    digest.update(bytes(5))
    row = training.file_hashes(spark, str(path)).first()
    assert (row["bytes"], row["sha256"]) == (size, digest.hexdigest())


def test_stage_and_drop(spark):
    staged = session.stage(spark.range(100), "t", parallel=True)
    assert staged.rdd.getNumPartitions() >= 8 and staged.count() == 100
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    session.drop_stage(staged)
    assert not pages.path_exists(spark, folder)


def test_incremental_extraction(spark, tmp_path):
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    spark.createDataFrame([("a", 1, "Influent COD 5 mg/L"), ("b", 1, "Effluent TN 2 mg/L")], PAGES).write.parquet(source)
    extract_stream(spark, source, out, mark).awaitTermination()
    spark.createDataFrame([("a", 1, "Influent COD 9 mg/L, length 3 m")], PAGES).write.mode("append").parquet(source)
    extract_stream(spark, source, out, mark).awaitTermination()
    rows = {r["pdf_name"]: r.asDict() for r in current_training(spark, out).collect()}
    assert rows["a"]["COD__influent"] == 9.0 and rows["a"]["长"] == 3.0 and rows["a"]["总氮__effluent"] is None
    assert rows["b"]["总氮__effluent"] == 2.0 and len(rows) == 2
    # a batch that runs again gives the same version
    apply_batch(spark.createDataFrame([("a", 1, "Influent COD 9 mg/L, length 3 m")], PAGES), 1, out)
    assert current_training(spark, out).count() == 2


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    from paramill.streaming import incremental

    out = str(tmp_path)
    pages = lambda rows: spark.createDataFrame(rows, PAGES)
    apply_batch(pages([(f"d{i}", 1, f"Influent COD was {i + 1} mg/L.") for i in range(300)]), 0, out)
    first = incremental.buckets_of(spark, out, 0)
    assert len(first) > 100 and set(first) <= set(range(incremental.BUCKETS))
    for batch in (1, 2, 3):
        apply_batch(pages([("d7", 1, f"Influent COD was {100 + batch} mg/L."), (f"new{batch}", 1, "HRT was 2 d.")]), batch, out)
        now = incremental.buckets_of(spark, out, batch)
        changed = [b for b in now if now[b] != incremental.buckets_of(spark, out, batch - 1).get(b)]
        assert 1 <= len(changed) <= 2
        names = {p.name for p in (tmp_path / "training" / f"batch={batch:010d}").iterdir() if p.is_dir()}
        assert len(names) == len(changed)  # files written follow the batch
    rows = {r["pdf_name"]: r.asDict() for r in current_training(spark, out).collect()}
    assert len(rows) == 303 and rows["d7"]["COD__influent"] == 103.0 and rows["d8"]["COD__influent"] == 9.0 and rows["new1"]["水力停留时间"] == 48.0
    assert {r["pdf_name"]: r["COD__influent"] for r in current_training(spark, out, before=3).collect()}["d7"] == 102.0
    d7 = next(b for b in incremental.buckets_of(spark, out, 3) if incremental.buckets_of(spark, out, 2)[b] != incremental.buckets_of(spark, out, 1)[b])
    assert d7 is not None and not (tmp_path / "training" / first[next(b for b in first if first[b] not in incremental.buckets_of(spark, out, 1).values())]).exists()
    apply_batch(pages([("d7", 1, "Influent COD was 103 mg/L."), ("new3", 1, "HRT was 2 d.")]), 3, out)  # again, as after a cut
    assert current_training(spark, out).count() == 303


def test_csv_records_over_many_splits(spark, tmp_path):
    import csv
    import random

    from paramill.sources.csv_records import csv_records, ends_inside, read_csv_text

    assert [ends_inside(x, i) for x in ('a,b', '"a', 'a"b,c', 'x","y"', '""', '"""', '"a""', 'b" tail,"c') for i in (False, True)] == [
        False, True, True, False, False, False, False, False, False, True, True, False, True, False, True, True,
    ]
    rng = random.Random(5)
    cells = ["", "plain", "a,b", 'say "hi"', "two\nlines", '"\n"', "\n\n", ",\n,", "x" * 90, "line,\n\"quoted\",\nagain", "é中"]
    rows = [[str(i), *(rng.choice(cells) for _ in range(3))] for i in range(400)]
    rows[100][1] = "long\n" * 300  # lies over many splits
    path = tmp_path / "many.csv"
    with path.open("w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "a", "b,c", "d"], *rows])
    serial = spark.read.csv(str(path), header=True, multiLine=True, escape='"', encoding="UTF-8")
    want = sorted(tuple(r) for r in serial.collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("300", "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            if size == "300":
                assert csv_records(spark, str(path)).count() == 401
            got = read_csv_text(spark, str(path))
            assert got.columns == serial.columns and sorted(tuple(r) for r in got.collect()) == want
            assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(want) == 400 and [r[1] for r in want if r[0] == "100"] == [rows[100][1]]


def test_lines_are_cut_once_for_header_types_and_values(spark, tmp_path, monkeypatch):
    from paramill.sources import csv_records

    (tmp_path / "a.csv").write_text('k,x,t\n1,2.5,"a\nb"\n\n2,nan,c\n')
    (tmp_path / "b.csv").write_text("k,x,t\n3,1e3,d\n4,,10d\n")
    staged = []
    monkeypatch.setattr(csv_records, "stage", lambda df, label: staged.append(label) or session.stage(df, label))
    rows = training.read_training_csv(spark, str(tmp_path))
    assert staged == ["csv-records"]
    assert sorted(map(tuple, rows.collect())) == [(1.0, 2.5, "a\nb"), (2.0, None, "c"), (3.0, 1000.0, "d"), (4.0, None, "10d")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("RLIKE") <= 6


def test_training_rows_are_dealt_to_tasks_by_rows(spark, folder):
    from paramill.plans import sample_inputs

    n = sample_inputs.training_rows(spark, folder).count()
    assert sample_inputs.training_rows(spark, folder, n // 12).rdd.getNumPartitions() in (12, 13)
