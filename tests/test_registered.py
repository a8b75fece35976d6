import pytest
from oracle_check import compare, connect, spark_entry

FAST_ROWS_ONLY = ["file_hash", "complete_designs"]


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_check_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_matches_sql(spark, con, folder, name):
    assert compare(spark, con, name, folder) is None


@pytest.mark.parametrize("name", FAST_ROWS_ONLY)
def test_query_runs(spark, folder, name):
    assert spark_entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0
