"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    message, n = compare(spark, con, SF_DIR, entry.queries()[name], SQL.get(name))
    assert message == ""
    assert n > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "split_name", "strategy", "n_train", "n_test", "r2", "rmse", "mae"]
    assert df.count() == 20


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())
