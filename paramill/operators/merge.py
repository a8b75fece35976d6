"""Keep-last upsert of training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GENERATION, _SEQUENCE = "_generation", "_sequence"


def merge_training(
    existing: DataFrame | None, new: DataFrame, key: str = "pdf_name", sequence: str | None = None
) -> DataFrame:
    """Union by column name; per key the last row wins as a whole.

    ``new`` comes after ``existing``. Within one table rows have no order of their own:
    ``sequence`` names the column that orders rows of equal key. An empty ``existing`` gives
    ``new`` as it is.

    The winner is picked by an aggregate, which combines before the shuffle, so a key with a
    large share of all rows costs one row per task.
    """
    if existing is None or existing.isEmpty():
        return new
    both = existing.withColumn(_GENERATION, F.lit(0)).unionByName(
        new.withColumn(_GENERATION, F.lit(1)), allowMissingColumns=True
    )
    columns = [c for c in both.columns if c != _GENERATION]
    if key not in columns:
        return both.select(*columns)
    order = [F.col(_GENERATION)]
    if sequence is not None:
        order.append(F.col(sequence))
    # rows that tie on the order are settled by content, so that reruns agree
    rest = [F.col(c) for c in columns if c not in (key, sequence)]
    last = F.max_by(F.struct(*columns), F.struct(*order, *rest))
    return both.groupBy(key).agg(last.alias("_last")).select("_last.*")
