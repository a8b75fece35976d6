import json

import numpy as np
import pandas as pd
import pytest
import paramill
from paramill.functions import constraints
from paramill.operators import imputation, splits, training
from paramill.sources.training import read_training_csv
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(10, 1, 60)
    data = pd.DataFrame({"长": x, "宽": x / 2 + rng.normal(0, 0.01, 60), "高": rng.normal(1.5, 0.1, 60)})
    data.loc[[2, 5, 9], "宽"] = np.nan
    return spark.createDataFrame(data)


def test_initial_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (5.0,), (None,)], "x double")
    got = {s: imputation.initial_values(df, ["x"], s)["x"] for s in imputation.STRATEGIES}
    assert got == {"mean": 3.0, "median": 2.0, "most_frequent": 2.0, "constant": 0.0}
    with pytest.raises(ValueError):
        imputation.initial_values(df, ["x"], "mode")


def test_linear_imputer_recovers_a_line(spark, gaps, tmp_path):
    model = imputation.ChainedImputer(estimator="linear", max_iter=3).fit(gaps)
    marked = gaps.withColumns({"id": F.col("高"), "was": F.col("宽")})
    rows = model.transform(marked).collect()
    assert all(r["宽"] is not None and not np.isnan(r["宽"]) for r in rows)
    assert all(r["宽"] == r["was"] for r in rows if r["was"] is not None and not np.isnan(r["was"]))
    guessed = [(r["宽"], r["长"] / 2) for r in rows if r["was"] is None or np.isnan(r["was"])]
    assert len(guessed) == 3 and all(abs(a - b) < 0.1 for a, b in guessed)
    model.save(spark, f"{tmp_path}/m")
    again = imputation.ChainedImputerModel.load(spark, f"{tmp_path}/m")
    design = spark.createDataFrame([("1", "12", None, "1.5"), ("2", "bad", "5", None)], "id string, `长` string, `宽` string, `高` string")
    out = {r["id"]: r for r in constraints.prepare_designs(design, ["id"], again).collect()}
    assert out["1"]["is_valid"] and out["1"]["宽"] == pytest.approx(6, abs=0.1)
    assert out["2"]["errors"][0] == "长: could not convert string to float: 'bad'"


def test_forest_imputer_and_evaluation(spark, gaps):
    forest = imputation.ChainedImputer(n_estimators=2, max_depth=3, max_iter=1)
    model = forest.fit(gaps.select("长", "宽"))
    assert model.rounds == 1 and [f for f, _ in model.steps] == ["长", "宽"]
    errors = imputation.evaluate_imputer(imputation.ChainedImputer(estimator="linear", max_iter=1), gaps.select("长", "宽"))
    assert set(errors) == {"长", "宽"} and 0 <= errors["宽"]["MAE"] < 0.2


def test_mask_size(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("x"))
    assert df.where(imputation.mask_known(df, "x", "id", 0.2)).count() == 10
    assert df.where(imputation.mask_known(df, "x", "id", 0.001)).count() == 1
    assert imputation.mask_known(df.limit(4), "x", "id") is None


@pytest.fixture(scope="module")
def grouped(tmp_path_factory):
    rng = np.random.default_rng(11)
    data = pd.DataFrame({"pdf_name": [f"study_{i // 6:02d}.pdf" for i in range(60)], "x1": rng.normal(size=60), "x2": rng.normal(size=60)})
    data["target"] = 2 * data.x1 - 0.5 * data.x2
    path = tmp_path_factory.mktemp("grouped") / "grouped.csv"
    data.to_csv(path, index=False)
    return str(path)


def test_supervised_experiment(spark, grouped, tmp_path):
    raw = read_training_csv(spark, grouped)
    result = paramill.train_supervised(
        raw, "target", f"{tmp_path}/model", n_splits=3, model_type="random_forest", params={"n_estimators": 8},
        report_path=f"{tmp_path}/report", data_path=grouped,
    )
    assert (result["validation_strategy"], result["source_column"], result["n_splits"]) == ("group_kfold", "pdf_name", 3)
    held = result["group_holdout"]
    assert held["test_source_count"] == 2 and not set(held["train_sources"]) & set(held["test_sources"])
    assert result["baseline"]["model_improvement_ratio"] > 0
    assert len(result["data_audit"]["sha256"]) == 64
    report = json.loads(spark.read.text(f"{tmp_path}/report").first()[0])
    assert report["type"] == "supervised_experiment" and report["data_audit"]["rows"] == 60
    model, meta = paramill.load_model(spark, f"{tmp_path}/model")
    assert meta["feature_names"] == ["x1", "x2"] == paramill.model_feature_names(spark, f"{tmp_path}/model")
    assert model.predict(raw).where("prediction is null").count() == 0
    assert spark.read.parquet(f"{tmp_path}/model/holdout_sources").count() == 10


def test_search_and_boosting(spark, grouped):
    raw = read_training_csv(spark, grouped).withColumnRenamed("pdf_name", "src")
    folded, folds, _ = splits.make_folds(raw, 2, "src")
    pipeline = training.SupervisedPipeline(["x1", "x2"], "target", "random_forest", {"n_estimators": 4})
    model, best, rmse, scores = training.grid_search(pipeline, folded, folds, [{"max_depth": 1}, {"max_depth": 6}])
    assert best == {"max_depth": 6} and rmse**2 == pytest.approx(min(s["MSE"] for s in scores))
    boosted = training.SupervisedPipeline(["x1", "x2"], "target", params={"n_estimators": 3})
    rows = boosted.fit(raw).predict(raw).collect()
    assert np.corrcoef([r["target"] for r in rows], [r["prediction"] for r in rows])[0, 1] > 0.7
    assert len(training.grid("random_forest")) == 36 and len(training.grid("gradient_boosting")) == 81


def test_imputer_experiment(spark, gaps, tmp_path):
    df = gaps.withColumn("same", F.lit(1.0))
    out = paramill.train_imputer(df, f"{tmp_path}/m", n_estimators=2, max_iter=1)
    assert out["feature_names"] == ["长", "宽", "高"] and set(out["errors"]) == {"长", "宽", "高"}
    model, meta = paramill.load_model(spark, f"{tmp_path}/m")
    assert meta["training_rows"] == 60 and model.features == ["长", "宽", "高"]
    with pytest.raises(ValueError):
        paramill.train_imputer(df.select("长", "same"), f"{tmp_path}/n")


def test_model_queries_run_the_library_defaults(spark, folder, monkeypatch):
    from paramill.plans.registered import REGISTRY

    class Stop(Exception):
        pass

    seen = []

    def note(what, end=True):
        def called(*args, **kwargs):
            seen.append((what, args, kwargs))
            if end:
                raise Stop
            return None, None, None, [{"n_estimators": 1, "MSE": 0.5}]

        return called

    monkeypatch.setattr(imputation.ChainedImputer, "fit", note("fit"))
    monkeypatch.setattr(training, "cross_validate", note("oof"))
    for name in ("imputer_fill", "imputer_eval", "rf_oof_metrics", "gbt_oof_metrics"):
        with pytest.raises(Stop):
            REGISTRY[name](spark, folder)
    assert all(args[0] == imputation.ChainedImputer() for _, args, _ in seen[:2])
    assert [(args[0].model_type, args[0].params, args[2]) for _, args, _ in seen[2:]] == [
        (training.RANDOM_FOREST, {}, 5), (training.GRADIENT_BOOSTING, {}, 5),
    ]
    seen.clear()
    monkeypatch.setattr(training, "grid_search", note("grid", end=False))
    rows = REGISTRY["grid_search"](spark, folder).collect()
    # three arguments: no settings of its own, so the library's grid
    assert [(args[0].model_type, args[0].params, len(args), kwargs) for _, args, kwargs in seen] == [(m, {}, 3, {}) for m in training.GRIDS]
    assert [(r.model_type, r.n_estimators, r.max_depth, r.mse) for r in rows] == [(m, 1, None, 0.5) for m in training.GRIDS]
