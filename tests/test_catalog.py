"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    _, n, verdict = compare(name, spark, con, SF, QUERIES, SQL)
    assert verdict in ("ok", "no sql"), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
