"""Regression metrics and the median baseline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramill.operators.quantiles import exact_quantiles
from paramill.operators.splits import FOLD

METRICS = ["MSE", "RMSE", "MAE", "MAPE", "MedAE", "R2"]
# smallest denominator of a relative error (double precision epsilon) -- fixed value
EPSILON = 2.220446049250313e-16


def regression_metrics(df: DataFrame, target: Column, prediction: Column) -> dict[str, float] | None:
    """All metrics of one prediction column; None for no rows."""
    pairs = df.select(target.cast("double").alias("y"), prediction.cast("double").alias("p"))
    error = F.col("y") - F.col("p")
    relative = F.abs(error) / F.greatest(F.abs("y"), F.lit(EPSILON))
    row = pairs.agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(relative).alias("mape"),
        F.var_pop("y").alias("spread"),
    ).first()
    if row["n"] == 0:
        return None
    median = exact_quantiles(pairs, [F.abs(error)], [0.5])[0][0]
    if row["spread"]:
        r2 = 1.0 - row["mse"] / row["spread"]
    else:
        # a constant target: perfect or worthless
        r2 = 1.0 if row["mse"] == 0 else 0.0
    values = [row["mse"], math.sqrt(row["mse"]), row["mae"], row["mape"], median, r2]
    return dict(zip(METRICS, values, strict=True))


def rmse_by_fold(df: DataFrame, target: Column, prediction: Column) -> list[float]:
    """RMSE per fold, in fold order."""
    error = target - prediction
    rows = df.groupBy(FOLD).agg(F.sqrt(F.avg(error * error)).alias("rmse")).collect()
    return [r["rmse"] for r in sorted(rows, key=lambda r: r[FOLD])]


def mean_and_deviation(values: list[float]) -> tuple[float, float]:
    """Mean and population standard deviation."""
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((x - mean) ** 2 for x in values) / len(values))


def median_baseline(df: DataFrame, target: Column, folds: int) -> list[float]:
    """RMSE per fold of predicting the median of the other folds."""
    others = [F.when(F.col(FOLD) != f, target) for f in range(folds)]
    medians = [m[0] for m in exact_quantiles(df, others, [0.5])]
    guess = F.element_at(F.array(*[F.lit(m).cast("double") for m in medians]), F.col(FOLD) + 1)
    return rmse_by_fold(df, target, guess)


def baseline_report(rmse: list[float], model_rmse: float | None = None) -> dict[str, object]:
    mean, deviation = mean_and_deviation(rmse)
    improvement = 1 - model_rmse / mean if model_rmse is not None and mean > 0 else None
    return {
        "strategy": "median",
        "rmse_mean": mean,
        "rmse_std": deviation,
        "model_improvement_ratio": improvement,
    }
