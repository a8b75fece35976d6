"""Compare registered queries with their SQL: same rows, whatever the order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(x: object) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "\0"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(float(x))
    return str(x)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> str | None:
    """None if both agree, else what differs."""
    df = spark_entry.queries()[name](spark, folder)
    got_columns = df.columns
    got = rows_of(got_columns, df.collect())
    result = con.execute(spark_entry.oracle_sql()[name])
    want_columns = [d[0] for d in result.description]
    want = rows_of(want_columns, result.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None


if __name__ == "__main__":
    from paramill.session import local_session

    folder = sys.argv[1]
    names = sys.argv[2:] or list(spark_entry.queries())
    spark, con = local_session(8), connect(folder)
    for name in names:
        start = time.time()
        try:
            if name in spark_entry.oracle_sql():
                found = compare(spark, con, name, folder)
            else:
                found = f"rows only: {spark_entry.queries()[name](spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            found = f"ERROR {type(e).__name__} {str(e)[:400]}"
        mark = "ok  " if found is None else "rows" if found.startswith("rows only") else "DIFF"
        print(f"{mark} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
