"""Training runs: load, check, fit, validate, report, save."""

from __future__ import annotations

import datetime
import platform

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramill.operators.audit import _c, audit
from paramill.operators.cleaning import SOURCE, drop_constant_columns, load_dataset, prepare_supervised
from paramill.operators.imputation import ChainedImputer, ChainedImputerModel, evaluate_imputer
from paramill.operators.metrics import baseline_report, mean_and_deviation, median_baseline, regression_metrics
from paramill.operators.splits import group_holdout, holdout_sources, make_folds
from paramill.operators.training import (
    GRADIENT_BOOSTING,
    PREDICTION,
    SupervisedModel,
    SupervisedPipeline,
    cross_validate,
    grid_search,
    read_json,
    write_json,
)
from paramill.session import drop_stage, stage
from paramill.sources.pages import path_exists
from paramill.sources.training import file_hashes

# source names listed in a report; longer lists are only in the table beside it
LISTED_SOURCES = 1000


def training_environment(spark: SparkSession) -> dict[str, str]:
    """When and with which versions a model was trained."""
    return {
        "trained_at_utc": datetime.datetime.now(datetime.UTC).isoformat(),
        "python": platform.python_version(),
        "numpy": np.__version__,
        "pandas": pd.__version__,
        "spark": spark.version,
    }


def audit_report(df: DataFrame, source_column: str | None = None, data_path: str | None = None) -> dict:
    """The audit as a dictionary; with a path also the file hashes."""
    report = audit(df, source_column).first().asDict(recursive=True)
    if data_path is not None:
        report["data_path"] = data_path
        hashes = file_hashes(df.sparkSession, data_path)
        # one file: its hash; a folder: a hash over an order-free combination of all hashes
        mixed = [F.bit_xor(F.xxhash64(F.lit(i), "sha256")).cast("string") for i in range(4)]
        row = hashes.agg(
            F.count("*").alias("files"), F.min("sha256").alias("only"), F.sha2(F.concat_ws(":", *mixed), 256).alias("all")
        ).first()
        report["sha256"] = row["only"] if row["files"] == 1 else row["all"]
    return report


def train_imputer(
    df: DataFrame,
    output_path: str,
    min_non_na_ratio: float = 0.2,
    n_estimators: int = 100,
    max_iter: int = 10,
    initial_strategy: str = "median",
    remove_outliers_flag: bool = False,
    require_reviewed: bool = False,
    report_path: str | None = None,
    data_path: str | None = None,
    mask_ratio: float = 0.2,
) -> dict:
    """Fit, save and evaluate an imputer over the varying numeric columns of ``df``."""
    spark = df.sparkSession
    data = load_dataset(df, min_non_na_ratio, remove_outliers_flag, require_reviewed)
    frame = drop_constant_columns(data.numeric())
    if len(frame.columns) < 2 or frame.isEmpty():
        raise ValueError("an imputer needs rows with two numeric columns or more that vary")
    frame = stage(frame, "training", parallel=True)
    imputer = ChainedImputer(
        n_estimators=n_estimators, max_iter=max_iter, initial_strategy=initial_strategy
    )
    model = imputer.fit(frame)
    report = audit_report(df, None, data_path)
    if report_path:
        write_json(spark, report, report_path)
    model.save(spark, f"{output_path}/imputer")
    write_json(
        spark,
        {
            "schema_version": 1,
            "type": "imputer",
            "feature_names": model.features,
            "input_features": model.features,
            "training_rows": frame.count(),
            "data_audit": report,
            "training_environment": training_environment(spark),
        },
        f"{output_path}/metadata",
    )
    errors = evaluate_imputer(imputer, frame, mask_ratio=mask_ratio)
    drop_stage(frame)
    return {
        "type": "imputer",
        "imputer": model,
        "feature_names": model.features,
        "max_iterations": max_iter,
        "initial_strategy": initial_strategy,
        "errors": errors,
    }


def _holdout(pipeline: SupervisedPipeline, df: DataFrame, size: float, seed: int, table_path: str | None):
    parts = group_holdout(df, SOURCE, size, seed)
    if parts is None:
        return None
    train, test = parts
    predicted = stage(pipeline.fit(train).predict(test), "holdout")
    metrics = regression_metrics(predicted, _c(pipeline.target), F.col(PREDICTION))
    drop_stage(predicted)
    sources = holdout_sources(df, SOURCE, size, seed)
    if table_path:
        # in order, however many: training sources first, each kind by name
        sources.orderBy("is_test", SOURCE).write.mode("overwrite").parquet(table_path)
    counts = {r["is_test"]: r["count"] for r in sources.groupBy("is_test").count().collect()}
    report = {
        "metrics": metrics,
        "train_rows": train.count(),
        "test_rows": test.count(),
        "train_source_count": counts.get(False, 0),
        "test_source_count": counts.get(True, 0),
        "sources_table": table_path,
    }
    if sum(counts.values()) <= LISTED_SOURCES:
        rows = sources.collect()
        report["train_sources"] = sorted(r[SOURCE] for r in rows if not r["is_test"])
        report["test_sources"] = sorted(r[SOURCE] for r in rows if r["is_test"])
    return report


def train_supervised(
    df: DataFrame,
    target: str,
    output_path: str,
    min_non_na_ratio: float = 0.2,
    n_splits: int = 5,
    random_state: int = 42,
    model_type: str = GRADIENT_BOOSTING,
    search: bool = False,
    remove_outliers_flag: bool = False,
    require_reviewed: bool = False,
    source_column: str | None = None,
    holdout_size: float = 0.2,
    report_path: str | None = None,
    data_path: str | None = None,
    params: dict | None = None,
    settings: list[dict] | None = None,
) -> dict:
    """Fit a regressor with validation by source, holdout and baseline; report and save.

    ``params`` overrides defaults of the model, ``settings`` the grid of a search. The audit
    describes ``df`` as given, before any filter.
    """
    spark = df.sparkSession
    data = prepare_supervised(
        load_dataset(df, min_non_na_ratio, remove_outliers_flag, require_reviewed, source_column), target
    )
    frame = stage(data.frame, "supervised", parallel=True)
    source = SOURCE if data.source else None
    folded, folds, strategy = make_folds(frame, n_splits, source, random_state)
    folded = stage(folded, "folds")
    pipeline = SupervisedPipeline(data.features, target, model_type, params or {}, seed=random_state)
    best = None
    if search:
        model, best, searched, _ = grid_search(pipeline, folded, folds, settings)
        pipeline.params = {**pipeline.params, **best}
        _, metrics = cross_validate(pipeline, folded, folds)
        cv_rmse = [searched]
    else:
        model = pipeline.fit(frame)
        cv_rmse, metrics = cross_validate(pipeline, folded, folds)
    cv_mean, cv_std = mean_and_deviation(cv_rmse)
    holdout = None
    if source:
        holdout = _holdout(pipeline, frame, holdout_size, random_state, f"{output_path}/holdout_sources")
    baseline = baseline_report(median_baseline(folded, _c(target), folds), cv_mean)
    report = {
        "type": "supervised_experiment",
        "target": target,
        "model_type": model_type,
        "random_state": random_state,
        "validation_strategy": strategy,
        "n_splits": folds,
        "source_column": data.source,
        "cv_rmse": {"value": cv_mean, "std": cv_std},
        "validation_metrics": metrics,
        "group_holdout": holdout,
        "baseline": baseline,
        "best_params": best,
        "data_audit": audit_report(df, source_column, data_path),
        "training_environment": training_environment(spark),
    }
    if report_path:
        write_json(spark, report, report_path)
    metadata = {
        "schema_version": 2,
        "type": "supervised",
        "feature_names": data.features,
        "input_features": data.features,
        "training_rows": frame.count(),
        "source_column": data.source,
        "validation_strategy": strategy,
        "n_splits": folds,
        "random_state": random_state,
        "data_sha256": report["data_audit"].get("sha256"),
        "data_audit": report["data_audit"],
        "validation_metrics": metrics,
        "group_holdout": holdout,
        "baseline": baseline,
        "training_environment": report["training_environment"],
    }
    model.save(spark, output_path, metadata)
    drop_stage(folded)
    drop_stage(frame)
    return {**report, "type": "supervised", "model": model}


def load_model(spark: SparkSession, path: str) -> tuple[ChainedImputerModel | SupervisedModel, dict]:
    """A saved model with its metadata."""
    if not path_exists(spark, f"{path}/metadata"):
        raise FileNotFoundError(path)
    meta = read_json(spark, f"{path}/metadata")
    if meta.get("type") == "imputer":
        return ChainedImputerModel.load(spark, f"{path}/imputer"), meta
    return SupervisedModel.load(spark, path), meta


def model_feature_names(spark: SparkSession, path: str) -> list[str] | None:
    meta = read_json(spark, f"{path}/metadata")
    return meta.get("feature_names") or meta.get("input_features")
