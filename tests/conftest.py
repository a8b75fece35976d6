import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paramill.session import local_session

    return local_session(8, "tests")


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture
def one(spark):
    """Evaluate one column expression over literal inputs."""
    from pyspark.sql import functions as F

    def run(expression, **inputs):
        row = spark.range(1).select(*[F.lit(x).alias(n) for n, x in inputs.items()])
        return row.select(expression.alias("out")).first()["out"]

    return run
