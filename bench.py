"""Times the headline queries: one warm-up, then the median of up to three runs.

A query is not run again once its timed runs have taken ten seconds.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (comma separated) a selection.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paramill.plans.registered import REGISTRY  # noqa: E402
from paramill.session import local_session  # noqa: E402

HEADLINE = [
    "scan_number_units",
    "extract_summary",
    "extract_detail",
    "training_pivot",
    "merge_upsert",
    "audit_report",
    "outlier_iqr",
    "outlier_iqr_one_pass",
    "load_dataset",
    "validate_params",
    "group_folds",
    "group_holdout",
    "regression_metrics",
    "baseline_rmse",
    "impute_initial",
    "imputer_fill",
]
RUNS, ENOUGH = 3, 10.0


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "bench")
    timed = {}
    for name in names:
        seconds(spark, name, folder)
        runs = [seconds(spark, name, folder)]
        while len(runs) < RUNS and sum(runs) < ENOUGH:
            runs.append(seconds(spark, name, folder))
        timed[name] = round(statistics.median(runs), 3)
        print(name, timed[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
