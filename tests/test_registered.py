"""Every registered query beside its SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

from tallyloom import registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()
# what the SQL of these says holds for forests on real numbers of rows, not on the smallest tables
FOREST = {"rf_metrics", "rf_history", "rf_save_load"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(set(SQL) - FOREST))
def test_query_equals_sql(spark, con, sf, name):
    problem, _ = compare(spark, con, sf, QUERIES[name], SQL[name])
    assert problem is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["category", "method", "step", "t", "yhat"]
    assert df.count() == 6 * 4 * 7
