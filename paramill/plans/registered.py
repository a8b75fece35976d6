"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramill import vocabulary as v
from paramill.functions import constraints, scoring, text
from paramill.operators import audit, cleaning, extraction, imputation, merge, metrics, ridge, splits, tables, training
from paramill.operators.audit import _c
from paramill.plans import experiments
from paramill.plans import sample_inputs as inputs
from paramill.session import drop_stage, shared_folder, stage
from paramill.sources import training as training_source

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SEED = 42


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.report_pages(spark, folder)


def _records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return tables.clean_detail(extraction.match_records(_pages(spark, folder)), list(columns))


def _row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# --- extraction -----------------------------------------------------------------------


@query
def scan_number_units(spark, folder):
    return extraction.scan_mentions(_pages(spark, folder)).select(
        "pdf_name", "page", "mention", "raw_value", "raw_unit"
    )


@query
def match_offsets(spark, folder):
    return extraction.mention_offsets(_pages(spark, folder))


@query
def context_window(spark, folder):
    rows = extraction.scan_mentions(_pages(spark, folder))
    context = F.translate(F.concat("before", "hit", "after"), "\n", " ")
    return rows.select(
        "pdf_name", "page", "mention", context.alias("context"), F.length("before").alias("value_pos")
    )


@query
def keyword_lookup(spark, folder):
    words = ["COD", "Nh3-N", "temp", "Dissolved Oxygen", "basin", "温度"]
    part = inputs.table(spark, folder, "part")
    word = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("p_partkey") % len(words) + 1).cast("int"))
    part = part.select("p_partkey", word.alias("word"))
    return part.withColumn("parameter", text.normalize_keyword(F.col("word")))


@query
def keyword_occurrences(spark, folder):
    found = inputs.first_sentences(spark, folder).select(
        "o_orderkey", F.explode(text.keyword_occurrences(F.col("text"))).alias("o")
    )
    return found.select("o_orderkey", "o.parameter", F.col("o.name").alias("alias"), "o.position")


@query
def role_occurrences(spark, folder):
    found = inputs.first_sentences(spark, folder).select("o_orderkey", F.explode(text.role_occurrences(F.col("text"))).alias("o"))
    return found.select("o_orderkey", "o.role", "o.position")


@query
def nearest_keyword(spark, folder):
    rows = inputs.first_sentences(spark, folder)
    rows = rows.withColumn("k", text.nearest_keyword(F.col("text"), F.col("value_pos")))
    return rows.select("o_orderkey", "k.parameter", "k.alias", "k.position")


@query
def classify_text(spark, folder):
    rows = inputs.first_sentences(spark, folder)
    return rows.select("o_orderkey", text.classify_text(F.col("text")).alias("category"))


@query
def water_role(spark, folder):
    rows = inputs.first_sentences(spark, folder)
    return rows.select(
        "o_orderkey",
        text.water_role(F.col("text")).alias("role_anywhere"),
        text.water_role(F.col("text"), F.col("value_pos")).alias("role_near"),
    )


@query
def classify_documents(spark, folder):
    """Category and role words of the given documents, whole texts."""
    docs = inputs.document_pages(spark, folder)
    return docs.select(
        "pdf_name",
        text.classify_text(F.col("text")).alias("category"),
        text.water_role(F.col("text")).alias("role"),
    )


@query
def parse_value_range(spark, folder):
    texts = ["12~22", "-5", "abc", " 7.5 ", "1e3", "1 - 3", "10d", "3－4"]
    key = F.col("o_orderkey")
    raw = F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))
    rows = inputs.table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.withColumn("value", scoring.parse_value(F.col("raw")))


_UNIT_SAMPLES = ["ug/L", "kg/m3", "m³/h", "L/day", "days", "ppb", "℃", "furlong"]


@query
def unit_normalize(spark, folder):
    unit = F.element_at(
        F.array(*[F.lit(u) for u in _UNIT_SAMPLES]), (F.col("l_partkey") % len(_UNIT_SAMPLES) + 1).cast("int")
    )
    rows = inputs.table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", unit.alias("raw_unit"))
    done = scoring.normalize_unit(F.col("l_quantity"), F.col("raw_unit"))
    return rows.withColumn("n", done).select(
        "l_orderkey", "raw_unit", F.round("n.value", 6).alias("value"), F.col("n.unit").alias("unit")
    )


@query
def category_lookup(spark, folder):
    names = ["COD", "水力负荷", "长", "芦苇", "温度", "unknown"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    rows = inputs.table(spark, folder, "part").select("p_partkey", name.alias("parameter"))
    return rows.withColumn("category", text.category_of(F.col("parameter")))


@query
def score_candidates(spark, folder):
    parameters = ["COD", "pH", "水力停留时间", "温度", "长", "种植密度", "芦苇"]
    units = ["mg/L", "", "h", "°C", "m", "acre"]
    item = inputs.table(spark, folder, "lineitem")
    value = F.when(F.col("l_linenumber") == 3, 1980 + F.col("l_quantity")).otherwise(F.col("l_quantity") - 10)
    rows = item.select(
        F.element_at(F.array(*[F.lit(x) for x in parameters]), F.col("l_linenumber").cast("int")).alias("parameter"),
        F.element_at(F.array(*[F.lit(x) for x in units]), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("unit"),
        value.alias("value"),
        (F.col("l_partkey") % 60).alias("distance"),
    )
    rows = rows.withColumn(
        "s", scoring.assess(F.col("parameter"), F.col("value"), F.col("unit"), F.col("distance"))
    )
    return rows.select("parameter", "unit", "value", "distance", "s.*")


@query
def extract_detail(spark, folder):
    return extraction.extract(_pages(spark, folder), keep_copies=False)


@query
def extract_listed_twice(spark, folder):
    """The same records where documents are listed twice and pages without text lie between."""
    return extraction.extract(inputs.listed_pages(spark, folder), keep_copies=False)


@query
def extract_summary(spark, folder):
    return tables.summary(
        _records(spark, folder, "pdf_name", "quality_status", "category", "parameter", "unit")
    )


@query
def extract_documents(spark, folder):
    return extraction.extract(inputs.woven_documents(spark, folder))


@query
def extract_conversations(spark, folder):
    return extraction.extract(inputs.woven_conversations(spark, folder))


_TRAINING = ["pdf_name", "quality_status", "category", "water_role", "parameter", "value"]

# --- tables -----------------------------------------------------------------------------


@query
def quality_report(spark, folder):
    return tables.quality_report(_records(spark, folder, "quality_status", "quality_reason"))


@query
def review_table(spark, folder):
    shown = ["pdf_name", "page", "water_role", "quality_status", "parameter", "value", "unit", "context"]
    records = tables.review_table(extraction.match_records(_pages(spark, folder)))  # before copies are looked for
    return tables.clean_detail(records, [*shown, "category"]).select(*shown)


@query
def training_pivot(spark, folder):
    wide = tables.training_table(_records(spark, folder, *_TRAINING), drop_empty=False)
    return wide.select("pdf_name", *[F.round(_c(c), 9).alias(c) for c in wide.columns[1:]])


@query
def run_counts(spark, folder):
    records = stage(_records(spark, folder, *_TRAINING), "records")
    counts = tables.run_counts(records, tables.training_table(records, drop_empty=False)).first().asDict()
    drop_stage(records)
    return _row(spark, counts)


@query
def merge_upsert(spark, folder):
    old, new = inputs.old_and_new_training(spark, folder)
    merged = merge.merge_training(old, new)
    return merged.select("pdf_name", "a", "b", "c")


@query
def merge_repeated_keys(spark, folder):
    """Of a key's rows the last of the newer table wins, in the order of the files."""
    old, new = inputs.repeated_keys(spark, folder)
    return merge.merge_training(old, new, sequence=training_source.FILE_ORDER).select("pdf_name", "a", "b", "c")


@query
def training_csv(spark, folder):
    """Training table written as CSV and read back with inferred types."""
    rows = inputs.training_rows(spark, folder, inputs.TASK_ROWS * 10).drop("empty")
    path = f"{shared_folder(spark)}/training-csv-{spark.sparkContext.applicationId}-{id(rows)}"
    training_source.write_training_csv(rows, path)
    back = training_source.read_training_csv(spark, path)
    return back.withColumn("source_id", F.col("source_id").cast("bigint"))


# --- audit --------------------------------------------------------------------------------


@query
def audit_report(spark, folder):
    rows = inputs.training_rows(spark, folder)
    report = audit.audit(rows.drop("quality_status", "review_status"))
    lists = ["all_missing_columns", "constant_numeric_columns", "warnings"]
    ratio = F.concat_ws(
        ";",
        *[
            F.concat_ws("=", F.lit(c), F.round(F.col("missing_ratio")[c], 6).cast("decimal(9,6)").cast("string"))
            for c in audit.numeric_columns(rows)
        ],
    )
    return report.withColumn("missing_ratio", ratio).withColumns({c: F.array_join(c, "|") for c in lists})


@query
def audit_missing_ratio(spark, folder):
    return audit.missing_ratios(inputs.training_rows(spark, folder)).withColumn(
        "missing_ratio", F.round("missing_ratio", 9)
    )


@query
def audit_constant_columns(spark, folder):
    rows = inputs.training_rows(spark, folder)
    flags = audit.constant_flags(rows, audit.numeric_columns(rows))
    return spark.createDataFrame(list(flags.items()), "column string, is_constant boolean")


@query
def audit_duplicates(spark, folder):
    items = inputs.table(spark, folder, "lineitem")
    return audit.duplicate_rows(items.select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))


# --- cleaning -----------------------------------------------------------------------------


@query
def filter_quality(spark, folder):
    return cleaning.filter_quality(inputs.training_rows(spark, folder)).select("source_id", "quantity", "price")


@query
def filter_reviewed(spark, folder):
    return cleaning.filter_reviewed(inputs.training_rows(spark, folder)).select("source_id", "quantity", "price")


@query
def select_by_missing_ratio(spark, folder):
    rows = inputs.training_rows(spark, folder)
    kept = cleaning.columns_by_missing_ratio(rows, audit.numeric_columns(cleaning.drop_metadata(rows)))
    return rows.select(*kept)


@query
def drop_all_null_rows(spark, folder):
    rows = inputs.training_rows(spark, folder).select("source_id", "quantity", "discount", "sparse")
    return cleaning.drop_all_null_rows(rows, ["quantity", "discount", "sparse"])


@query
def drop_constant_columns(spark, folder):
    rows = inputs.training_rows(spark, folder).drop("quality_status", "review_status")
    return cleaning.drop_constant_columns(rows)


@query
def outlier_iqr(spark, folder):
    rows = inputs.training_rows(spark, folder).select("source_id", "price", "quantity", "discount")
    return cleaning.remove_outliers(rows, "iqr", 1.5)


@query
def outlier_iqr_one_pass(spark, folder):
    rows = inputs.training_rows(spark, folder).select("source_id", "price", "quantity", "discount")
    return cleaning.remove_outliers(rows, "iqr", 0.3, sequential=False)


@query
def outlier_zscore(spark, folder):
    rows = inputs.training_rows(spark, folder).select("source_id", "price", "quantity", "constant")
    return cleaning.remove_outliers(rows, "zscore", 1.5, columns=["price", "quantity"])


@query
def load_dataset(spark, folder):
    rows = inputs.training_rows(spark, folder)
    data = cleaning.load_dataset(rows, 0.5, remove_outliers_flag=True, require_reviewed=True)
    return data.frame.withColumnRenamed(cleaning.SOURCE, "source")


# --- designs ------------------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    df = df.withColumn("errors", F.array_join("errors", "|"))
    if "note" in df.columns:
        df = df.withColumns({"note_number": F.col("note.num"), "note_text": F.col("note.txt")}).drop("note")
    return df


@query
def coerce_params(spark, folder):
    done = constraints.coerce_designs(inputs.designs(spark, folder), ["design_id"])
    return _flat(done.withColumnRenamed("_faults", "errors"))


@query
def apply_defaults(spark, folder):
    return constraints.apply_defaults(inputs.designs(spark, folder)).select("design_id", *v.DESIGN_FIELDS)


@query
def validate_params(spark, folder):
    return _flat(constraints.validate_designs(inputs.designs(spark, folder), v.DESIGN_FIELDS, ["design_id"]))


@query
def prepare_designs(spark, folder):
    return _flat(constraints.prepare_designs(inputs.designs(spark, folder), ["design_id"]))


@query
def select_features(spark, folder):
    return constraints.select_features(inputs.designs(spark, folder), ["design_id", "长", "COD"])


@query
def display_names(spark, folder):
    names = [*v.SPECS, "unknown"]
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    rows = inputs.table(spark, folder, "part").select("p_partkey", name.alias("name"))
    return rows.select(
        "p_partkey", "name", constraints.unit_of(F.col("name")).alias("unit"),
        constraints.display_name(F.col("name")).alias("display_name"),
    )


def _valid_designs(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.valid_designs(constraints.prepare_designs(inputs.designs(spark, folder), ["design_id"]))


@query
def design_brief(spark, folder):
    designs = _valid_designs(spark, folder)
    return designs.select("design_id", constraints.design_brief(designs).alias("brief"))


@query
def partition_layout(spark, folder):
    walls = constraints.partition_layout(_valid_designs(spark, folder), ["design_id"])
    return walls.withColumns({c: F.round(c, 6) for c in ("wall_x", "opening_y", "opening_height")})


# --- splits and metrics -------------------------------------------------------------------


@query
def group_folds(spark, folder):
    items = inputs.table(spark, folder, "lineitem").select("l_suppkey")
    folded, _ = splits.group_folds(items, "l_suppkey", 5, SEED)
    return folded.groupBy("l_suppkey", "fold").agg(F.count("*").alias("rows"))


@query
def hash_folds(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey")
    return splits.hash_folds(orders, 5, SEED, "o_orderkey")[0]


@query
def group_holdout(spark, folder):
    items = inputs.table(spark, folder, "lineitem").select("l_suppkey", "l_quantity")
    train, test = splits.group_holdout(items, "l_suppkey", 0.2, SEED)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("l_suppkey", "part").agg(F.count("*").alias("rows"))


def _closed_form(spark: SparkSession, folder: str) -> DataFrame:
    items = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_quantity", "l_discount"
    )
    guess = F.col("l_quantity") * 2000 * (1 - F.col("l_discount"))
    return items.select("l_orderkey", _c("l_extendedprice").alias("y"), guess.alias("p"))


@query
def regression_metrics(spark, folder):
    found = metrics.regression_metrics(_closed_form(spark, folder), F.col("y"), F.col("p"))
    digits = {"MSE": 1, "RMSE": 4, "MAE": 4, "MAPE": 8, "MedAE": 4, "R2": 8}
    return _row(spark, {name: round(found[name], d) for name, d in digits.items()})


@query
def baseline_rmse(spark, folder):
    folded, folds = splits.hash_folds(_closed_form(spark, folder), 5, SEED, "l_orderkey")
    folded = stage(folded.select("y", "fold"), "folds", parallel=True)
    rmse = metrics.median_baseline(folded, F.col("y"), folds)
    drop_stage(folded)
    return spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(rmse)], "fold int, rmse double")


# --- imputation and models ---------------------------------------------------------------


@query
def impute_initial(spark, folder):
    rows = inputs.training_rows(spark, folder).select("quantity", "discount", "sparse")
    found = {s: imputation.initial_values(rows, rows.columns, s) for s in imputation.STRATEGIES}
    return spark.createDataFrame(
        [(c, *[round(float(found[s][c]), 6) for s in imputation.STRATEGIES]) for c in rows.columns],
        "feature string, " + ", ".join(f"{s} double" for s in imputation.STRATEGIES),
    )


@query
def impute_mask(spark, folder):
    orders = inputs.table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("price")
    )
    hide = imputation.mask_known(orders, "price", "o_orderkey", 0.2, SEED)
    return orders.where(hide).select("o_orderkey", "price")


@query
def bayesian_ridge(spark, folder):
    """The default estimator of the pipelines' imputer: price from quantity and discount, known rows."""
    rows = inputs.training_rows(spark, folder).select("quantity", "discount", "price").dropna()
    (whole,) = ridge.pattern_moments(rows, rows.columns, [0.0] * 3, 1)
    fit = ridge.bayesian_ridge(whole.moments)
    return _row(
        spark,
        {
            "rows": int(whole.rows),
            "quantity": round(float(fit.coefficients[0]), 4),
            "discount": round(float(fit.coefficients[1]), 2),
            "intercept": round(fit.intercept, 2),
            "noise": round(fit.noise_precision**-0.5, 2),
            "spread": round(fit.weight_precision**-0.5, 2),
            "rounds": fit.rounds,
        },
    )


def _numeric_rows(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.training_rows(spark, folder).select(
        "quantity", F.col("price"), "discount"
    )


@query
def imputer_fill(spark, folder):
    rows = _numeric_rows(spark, folder)
    return imputation.ChainedImputer().fit(rows).transform(rows)


@query
def imputer_eval(spark, folder):
    rows = _numeric_rows(spark, folder)
    errors = imputation.evaluate_imputer(imputation.ChainedImputer(), rows)
    return spark.createDataFrame(
        [(c, e["MSE"], e["MAE"]) for c, e in errors.items()], "feature string, mse double, mae double"
    )


def _folded(spark: SparkSession, folder: str, folds: int) -> tuple[DataFrame, int]:
    rows = inputs.training_rows(spark, folder).select("source_id", "quantity", "price", "discount")
    # written first: the folds read the rows several times, and a file of few splits is read by few tasks
    rows = stage(rows.where("price is not null"), "fold-input", parallel=True)
    folded, folds, _ = splits.make_folds(rows, folds, "source_id", SEED)
    folded = stage(folded, "folds", parallel=True)
    drop_stage(rows)
    return folded, folds


def _pipeline(model_type: str) -> training.SupervisedPipeline:
    return training.SupervisedPipeline(["quantity", "discount"], "price", model_type)


def _oof(spark: SparkSession, folder: str, model_type: str) -> DataFrame:
    folded, folds = _folded(spark, folder, 5)
    _, found = training.cross_validate(_pipeline(model_type), folded, folds)
    drop_stage(folded)
    return _row(spark, found)


@query
def rf_oof_metrics(spark, folder):
    return _oof(spark, folder, training.RANDOM_FOREST)


@query
def gbt_oof_metrics(spark, folder):
    return _oof(spark, folder, training.GRADIENT_BOOSTING)


@query
def grid_search(spark, folder):
    """Scores of both library grids."""
    folded, folds = _folded(spark, folder, 5)
    found = []
    with training.views_kept():
        for model_type in training.GRIDS:
            _, _, _, scores = training.grid_search(_pipeline(model_type), folded, folds)
            found += [{"model_type": model_type, **s} for s in scores]
    drop_stage(folded)
    kinds = {
        "model_type": "string", "n_estimators": "int", "max_depth": "int", "min_samples_leaf": "int",
        "learning_rate": "double", "subsample": "double", "MSE": "double",
    }
    schema = ", ".join(f"{c.lower()} {kind}" for c, kind in kinds.items())
    return spark.createDataFrame([tuple(s.get(c) for c in kinds) for s in found], schema)


@query
def supervised_experiment(spark, folder):
    """The whole training run with its default model: folds by source, holdout, baseline, audit, saved model."""
    rows = inputs.training_rows(spark, folder).select("source_id", "quantity", "price", "discount", "quality_status", "review_status")
    path = f"{shared_folder(spark)}/supervised-{uuid.uuid4().hex}"
    found = experiments.train_supervised(rows, "price", path)
    held = found["group_holdout"]
    return _row(
        spark,
        {
            "strategy": found["validation_strategy"],
            "folds": found["n_splits"],
            "cv_rmse": found["cv_rmse"]["value"],
            "cv_rmse_std": found["cv_rmse"]["std"],
            "oof_rmse": found["validation_metrics"]["RMSE"],
            "baseline_rmse": found["baseline"]["rmse_mean"],
            "improvement": found["baseline"]["model_improvement_ratio"],
            "holdout_rmse": held["metrics"]["RMSE"],
            "train_sources": held["train_source_count"],
            "test_sources": held["test_source_count"],
            "rows_audited": found["data_audit"]["rows"],
        },
    )


@query
def complete_designs(spark, folder):
    """Designs whose missing numbers an imputer fills before defaults and checks."""
    raw = inputs.designs(spark, folder)
    names = ["长", "宽", "高", "water_depth", "水力停留时间"]
    numbers = scoring.with_numbers(raw, {f"_n{i}": _c(n) for i, n in enumerate(names)}).select(*[F.col(f"_n{i}").alias(n) for i, n in enumerate(names)])
    model = imputation.ChainedImputer(estimator="bayesian_ridge", initial_strategy="mean").fit(numbers)
    return _flat(constraints.prepare_designs(raw, ["design_id"], model))


@query
def file_hash(spark, folder):
    hashes = training_source.file_hashes(spark, f"{folder}/*.parquet")
    return hashes.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")
