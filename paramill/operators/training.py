"""Regression pipelines: impute, then a forest or boosted trees; validation and search.

Trees split by order alone, so features are not standardised first: it would change no split.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paramill.operators.audit import _c, nan_to_null
from paramill.operators.imputation import ChainedImputer, ChainedImputerModel, numbers_of
from paramill.operators.metrics import regression_metrics, rmse_by_fold
from paramill.operators.splits import FOLD
from paramill.operators.trees import Folds, Model, Spec, Table, fit_models, held_out_errors
from paramill.session import drop_stage, ship, stage

PREDICTION = "prediction"
RANDOM_FOREST, GRADIENT_BOOSTING = "random_forest", "gradient_boosting"

# --- fixed values: default settings and search grids ---------------------------------
DEFAULTS = {
    RANDOM_FOREST: {"n_estimators": 100, "max_depth": 10, "min_samples_leaf": 2},
    GRADIENT_BOOSTING: {
        "n_estimators": 200, "learning_rate": 0.1, "max_depth": 5, "min_samples_leaf": 2, "subsample": 0.8,
    },
}
GRIDS = {
    RANDOM_FOREST: {
        "n_estimators": [100, 150, 200],
        "max_depth": [5, 10, 15, None],
        "min_samples_leaf": [1, 2, 4],
    },
    GRADIENT_BOOSTING: {
        "n_estimators": [100, 200, 300],
        "learning_rate": [0.01, 0.1, 0.2],
        "max_depth": [3, 5, 7],
        "subsample": [0.7, 0.8, 0.9],
    },
}
# stands for "no limit"
DEEPEST = 30


@dataclass
class SupervisedPipeline:
    """Settings of a regression pipeline over named features."""

    features: list[str]
    target: str
    model_type: str = GRADIENT_BOOSTING
    params: dict = field(default_factory=dict)
    imputer: ChainedImputer = field(
        default_factory=lambda: ChainedImputer(estimator="bayesian_ridge", initial_strategy="mean")
    )
    seed: int = 42

    def spec(self, held: int | None = None, **more) -> Spec:
        """The family of fits that these settings belong to."""
        p = {**DEFAULTS[self.model_type], **self.params, **more}
        marks = tuple(p.get("marks", ()))
        depth = p["max_depth"] or DEEPEST
        if self.model_type == RANDOM_FOREST:
            return Spec(p["n_estimators"], depth, p["min_samples_leaf"], held=held, seed=self.seed, marks=marks, depths=tuple(p.get("depths", (depth,) if marks else ())))
        return Spec(
            p["n_estimators"], depth, p["min_samples_leaf"], p["learning_rate"], p["subsample"], held, self.seed, marks, (depth,) if marks else ()
        )

    def fit(self, df: DataFrame) -> SupervisedModel:
        imputer = self.imputer.fit(df, self.features)
        table = Table(imputer.transform(df.select(*[_c(c) for c in (*self.features, self.target)])), self.features, self.target)
        model = fit_models(table, [self.spec()])[0]
        table.drop()
        return SupervisedModel(self.features, self.target, imputer, model)


@dataclass
class SupervisedModel:
    features: list[str]
    target: str
    imputer: ChainedImputerModel = field(repr=False)
    model: Model = field(repr=False)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with a prediction; its own columns pass unchanged. One narrow pass over the rows."""
        names = [c for c in df.columns if c != PREDICTION]
        df = df.select(*[_c(c) for c in names])
        at = {c: i for i, c in enumerate(names)}
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            own = shared.value
            for batch in batches:
                filled = own.imputer.filled(np.stack([numbers_of(batch, at.get(f)) for f in own.features]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.model.predict(filled))], names=[*names, PREDICTION])

        ship(df.sparkSession)
        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(PREDICTION, T.DoubleType())]))

    def save(self, spark: SparkSession, path: str, metadata: dict | None = None) -> None:
        self.imputer.save(spark, f"{path}/imputer")
        self.model.save(spark, f"{path}/model")
        meta = {"features": self.features, "target": self.target, **(metadata or {})}
        write_json(spark, meta, f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SupervisedModel:
        meta = read_json(spark, f"{path}/metadata")
        imputer = ChainedImputerModel.load(spark, f"{path}/imputer")
        return cls(meta["features"], meta["target"], imputer, Model.load(spark, f"{path}/model", meta["features"]))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    text = json.dumps(value, ensure_ascii=False, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def _together(spark: SparkSession, work, items: list, parallelism: int) -> list:
    """``work`` of every item, some at a time from threads of the driver."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def out_of_fold(pipeline: SupervisedPipeline, df: DataFrame, folds: int, parallelism: int = 5) -> DataFrame:
    """Each row's prediction by the model that has not seen its fold."""

    def part(f: int) -> DataFrame:
        model = pipeline.fit(df.where(F.col(FOLD) != f))
        return model.predict(df.where(F.col(FOLD) == f).select(FOLD, _c(pipeline.target), *[_c(c) for c in pipeline.features]))

    parts = _together(df.sparkSession, part, list(range(folds)), parallelism)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    # staged: the metrics read the predictions several times
    return stage(out.select(FOLD, _c(pipeline.target), PREDICTION), "predictions")


def cross_validate(pipeline: SupervisedPipeline, df: DataFrame, folds: int) -> tuple[list[float], dict]:
    """``(RMSE per fold, metrics of the pooled out-of-fold predictions)``."""
    predicted = out_of_fold(pipeline, df, folds)
    target, guess = _c(pipeline.target), F.col(PREDICTION)
    found = rmse_by_fold(predicted, target, guess), regression_metrics(predicted, target, guess)
    drop_stage(predicted)
    return found


def grid(model_type: str) -> list[dict]:
    names = list(GRIDS[model_type])
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*GRIDS[model_type].values())]


def families(pipeline: SupervisedPipeline, settings: list[dict]) -> dict[tuple, list[dict]]:
    """Settings that one fit answers together: those that differ in the number of trees and, in
    forests, in depth."""
    nested = ("n_estimators", "max_depth") if pipeline.model_type == RANDOM_FOREST else ("n_estimators",)
    out: dict[tuple, list[dict]] = {}
    for s in settings:
        whole = {**DEFAULTS[pipeline.model_type], **pipeline.params, **s}
        out.setdefault(tuple(sorted((k, v or 0) for k, v in whole.items() if k not in nested)), []).append(whole)
    return out


def folds_filled(df: DataFrame, pipeline: SupervisedPipeline, imputers: list[ChainedImputerModel]) -> DataFrame:
    """The rows of ``df``, equal ones together, filled by the imputer of each fold: for :class:`Folds`, written."""
    names = [f"x{i}" for i in range(len(pipeline.features))]
    raw = nan_to_null(df.select(*[_c(c).cast("double").alias(x) for c, x in zip(pipeline.features, names, strict=True)], _c(pipeline.target).cast("double").alias("y"), F.col(FOLD).cast("int").alias("fold")))
    raw = raw.groupBy(*names, "y", "fold").agg(F.count("*").alias("n"))
    # by what is known of a row, so that it is drawn alike whatever fills its gaps
    raw = raw.select(*names, "y", "n", "fold", F.xxhash64(*[F.coalesce(x, F.lit(float("nan"))) for x in names], "y", "fold").alias("key"))
    shared = df.sparkSession.sparkContext.broadcast(imputers)

    def run(batches):
        for batch in batches:
            values = np.stack([numbers_of(batch, i) for i in range(len(names))])
            filled = [pa.array(x) for imputer in shared.value for x in imputer.filled(values)]
            yield pa.RecordBatch.from_arrays([*filled, *batch.columns[len(names) :]], names=schema.names)

    schema = T.StructType([T.StructField(f"v{f}{x}", T.DoubleType()) for f in range(len(imputers)) for x in names] + raw.schema.fields[len(names) :])
    ship(df.sparkSession)
    return stage(raw.mapInArrow(run, schema), "fold-rows", parallel=True)


#: Views of tables that searches share, by what they depend on.
_kept: ContextVar[dict | None] = ContextVar("_kept", default=None)


@contextmanager
def views_kept() -> Iterator[None]:
    """Searches inside over the same table, features and imputer share what each fold sees."""
    kept: dict = {}
    before = _kept.set(kept)
    try:
        yield
    finally:
        _kept.reset(before)
        for views in kept.values():
            views.drop()


def fold_views(pipeline: SupervisedPipeline, df: DataFrame, folds: int, parallelism: int = 2) -> Folds:
    """The rows as the fits of every held fold see them, for any model over the same features."""

    def imputer(f: int) -> ChainedImputerModel:
        return pipeline.imputer.fit(df.where(F.col(FOLD) != f), pipeline.features)

    imputers = _together(df.sparkSession, imputer, list(range(folds)), parallelism)
    return Folds(folds_filled(df, pipeline, imputers), pipeline.features, folds)


def grid_search(
    pipeline: SupervisedPipeline,
    df: DataFrame,
    folds: int,
    settings: list[dict] | None = None,
    parallelism: int = 2,
) -> tuple[SupervisedModel, dict, float, list[dict]]:
    """Best setting by mean squared error over the folds, refitted on all rows.

    Gives ``(model, best setting, sqrt of its mean MSE, all scores)``. The imputer has no setting
    to search, so each fold is imputed and binned once for all settings, settings that nest share a fit,
    and one pass over the rows draws for all folds. Folds without rows have no error and no say.
    """
    settings = settings if settings is not None else grid(pipeline.model_type)
    own = families(pipeline, settings)

    def specs(f: int) -> list[Spec]:
        out = []
        for members in own.values():
            sizes = sorted({m["n_estimators"] for m in members})
            depths = sorted({m["max_depth"] or DEEPEST for m in members})
            trial = SupervisedPipeline(pipeline.features, pipeline.target, pipeline.model_type, members[0], pipeline.imputer, pipeline.seed)
            out.append(trial.spec(f, n_estimators=sizes[-1], max_depth=depths[-1], marks=sizes, depths=depths))
        return out

    kept = _kept.get()
    name = id(df), tuple(pipeline.features), pipeline.target, repr(pipeline.imputer), folds
    views = (kept or {}).get(name) or fold_views(pipeline, df, folds, parallelism)
    wanted = [specs(f) for f in range(folds)]
    found = views.errors([s for own_specs in wanted for s in own_specs])

    def errors(f: int) -> list[dict]:
        table = views.table(f)
        out = held_out_errors(table, wanted[f])
        table.drop()
        return out

    if found is None:
        per_fold = _together(df.sparkSession, errors, list(range(folds)), parallelism)
    else:
        per_fold = [found[f * len(own) : (f + 1) * len(own)] for f in range(folds)]
    if kept is None:
        views.drop()
    else:
        kept[name] = views
    place = {id(m): i for i, members in enumerate(own.values()) for m in members}
    scores = []
    for s in settings:
        whole = {**DEFAULTS[pipeline.model_type], **pipeline.params, **s}
        member = next(m for members in own.values() for m in members if m == whole)
        at = whole["n_estimators"], whole["max_depth"] or DEEPEST
        parts = [found[place[id(member)]][at] for found in per_fold]
        means = [e / n for e, n in parts if n]
        scores.append(sum(means) / len(means))
    best = min(range(len(settings)), key=lambda i: scores[i])
    chosen = SupervisedPipeline(
        pipeline.features, pipeline.target, pipeline.model_type, {**pipeline.params, **settings[best]},
        pipeline.imputer, pipeline.seed,
    )
    table = [{**s, "MSE": x} for s, x in zip(settings, scores, strict=True)]
    return chosen.fit(df), settings[best], math.sqrt(scores[best]), table
