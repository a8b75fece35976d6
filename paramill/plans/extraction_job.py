"""Pages in, five tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paramill.operators.extraction import extract
from paramill.operators.merge import merge_training
from paramill.operators.tables import build_tables, run_counts, with_values
from paramill.session import drop_stage, stage
from paramill.sources.training import write_tables, write_training_csv


def extract_tables(
    pages: DataFrame,
    output_folder: str,
    csv_path: str | None = None,
    existing: DataFrame | None = None,
    sequence: str | None = None,
) -> dict[str, int]:
    """Extract, build and write all tables; merge the training table into an earlier one.

    The detail is staged once and feeds every table. Returns the row counts of the run.
    """
    detail = stage(with_values(extract(pages, keep_copies=False)), "detail")
    if detail.isEmpty():
        raise ValueError("the pages hold no mention of a known parameter")
    tables = build_tables(detail)
    if existing is not None:
        tables["training"] = merge_training(existing, tables["training"], sequence=sequence)
    tables["training"] = stage(tables["training"], "training")
    write_tables(tables, output_folder)
    if csv_path:
        write_training_csv(tables["training"], csv_path)
    counts = run_counts(tables["detail"], tables["training"]).first().asDict()
    drop_stage(tables["training"])
    drop_stage(detail)
    return counts
