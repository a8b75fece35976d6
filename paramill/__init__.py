"""Parameter extraction, training tables, validation and tabular models on Spark."""

from paramill.functions.constraints import prepare_designs
from paramill.operators.extraction import extract
from paramill.operators.merge import merge_training
from paramill.operators.tables import build_tables
from paramill.plans.experiments import load_model, model_feature_names, train_imputer, train_supervised
from paramill.plans.extraction_job import extract_tables

__all__ = [
    "build_tables",
    "extract",
    "extract_tables",
    "load_model",
    "merge_training",
    "model_feature_names",
    "prepare_designs",
    "train_imputer",
    "train_supervised",
]
