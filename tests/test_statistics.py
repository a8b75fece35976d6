import math

import numpy as np
import pytest
from paramill.operators import metrics, quantiles, splits
from pyspark.sql import functions as F


@pytest.fixture
def tight(monkeypatch):
    """Brackets instead of gathering, also on small data."""
    monkeypatch.setattr(quantiles, "GATHER_LIMIT", 20)


def _columns():
    rng = np.random.default_rng(5)
    n = 3000
    return {
        "normal": rng.normal(size=n),
        "ties": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 50, n)).astype(float),
        "wide": np.exp(rng.normal(0, 40, n)),
        "one": np.full(n, 3.0),
    }


def test_exact_quantiles(spark, tight):
    data = _columns()
    df = spark.createDataFrame(list(zip(*[c.tolist() for c in data.values()], strict=True)), list(data))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9995, 1.0]
    found = quantiles.exact_quantiles(df, [F.col(c) for c in data], probs)
    for got, c in zip(found, data.values(), strict=True):
        assert got == pytest.approx(np.quantile(c, probs).tolist(), rel=1e-12)


def test_quantiles_ignore_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, None), (4.0, None), (9.0, None)], "x double, y double")
    assert quantiles.exact_quantiles(df, [F.col("x"), F.col("y")], [0.25, 0.5]) == [[1.75, 3.0], [None, None]]


def _sources(spark, sizes):
    rows = [(s, float(i)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "src string, x double")


def test_group_folds_keep_sources_whole(spark):
    sizes = {"hot": 400, **{f"s{i}": 20 for i in range(40)}}
    folded, folds, strategy = splits.make_folds(_sources(spark, sizes), 5, "src")
    assert (folds, strategy) == (5, "group_kfold")
    assert folded.groupBy("src").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    load = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert load == [200, 200, 200, 200, 400]


def test_light_sources_fill_the_room_left(spark, monkeypatch):
    monkeypatch.setattr(splits, "HEAVY", 1)
    sizes = {"hot": 1600, **{f"s{i}": 3 for i in range(1000)}}
    folded, _ = splits.group_folds(_sources(spark, sizes), "src", 3)
    load = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert max(load.values()) < 1700 and min(load.values()) > 1300


def test_fewer_than_three_sources_fall_back(spark):
    df = _sources(spark, {"a": 30, "b": 30})
    folded, folds, strategy = splits.make_folds(df, 4, "src")
    assert (folds, strategy) == (4, "kfold")
    assert folded.select("fold").distinct().count() == 4
    assert splits.group_holdout(df, "src") is None
    assert splits.hash_folds(df.limit(2), 5)[1] == 2


@pytest.mark.parametrize("rows", [3, 5, 6, 20])
def test_no_fold_is_empty(spark, rows):
    df = spark.createDataFrame([(i, float(i)) for i in range(rows)], "id int, y double")
    folded, folds = splits.hash_folds(df, 5, 42, "id")
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    assert folds == min(5, rows) and sorted(sizes) == list(range(folds))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert len(metrics.median_baseline(folded, F.col("y"), folds)) == folds


def test_null_sources_are_one_group(spark):
    df = spark.createDataFrame([(None, 1.0)] * 9 + [("a", 1.0), ("b", 1.0), ("c", 1.0)], "src string, x double")
    folded, folds = splits.group_folds(df, "src", 5)
    assert folds == 3
    assert folded.where("src is null").select("fold").distinct().count() == 1
    train, test = splits.group_holdout(df, "src", 0.2)
    assert test.count() == 1 and train.count() == 11


def test_group_holdout_size(spark):
    df = _sources(spark, {f"s{i}": 3 for i in range(21)})
    train, test = splits.group_holdout(df, "src", 0.2)
    assert test.select("src").distinct().count() == math.ceil(0.2 * 21)
    assert train.join(test, "src", "left_semi").count() == 0
    assert splits.holdout_sources(df, "src", 0.2).where("is_test").count() == 5
    with pytest.raises(ValueError):
        splits.group_holdout(df, "src", 1.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 1.0), (0.0, 0.5)], "y double, p double")
    m = metrics.regression_metrics(df, F.col("y"), F.col("p"))
    assert m["RMSE"] ** 2 == pytest.approx(m["MSE"]) == pytest.approx((1 + 0 + 9 + 0.25) / 4)
    assert m["MAE"] == pytest.approx(4.5 / 4) and m["MedAE"] == pytest.approx(0.75)
    assert m["MAPE"] == pytest.approx((1 + 0 + 0.75 + 0.5 / metrics.EPSILON) / 4)
    assert m["R2"] == pytest.approx(1 - 10.25 / (4 * np.var([1, 2, 4, 0])))
    flat = df.select(F.lit(3.0).alias("y"), "p")
    assert metrics.regression_metrics(flat, F.col("y"), F.col("p"))["R2"] == 0.0
    assert metrics.regression_metrics(flat, F.col("y"), F.col("y"))["R2"] == 1.0
    assert metrics.regression_metrics(df.limit(0), F.col("y"), F.col("p")) is None


def test_median_baseline(spark):
    y = [1.0, 5.0, 9.0, 2.0, 8.0, 4.0]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(y)], "y double, fold int")
    got = metrics.median_baseline(df, F.col("y"), 3)
    for f in range(3):
        mine = [v for i, v in enumerate(y) if i % 3 == f]
        rest = np.median([v for i, v in enumerate(y) if i % 3 != f])
        assert got[f] == pytest.approx(math.sqrt(np.mean([(v - rest) ** 2 for v in mine])))
    report = metrics.baseline_report(got, got[0])
    assert report["rmse_mean"] == pytest.approx(np.mean(got)) and report["rmse_std"] == pytest.approx(np.std(got))
    assert metrics.baseline_report([0.0, 0.0], 1.0)["model_improvement_ratio"] is None
