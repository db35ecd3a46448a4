"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
import oracle
from conftest import SF_DIR

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    problem = oracle.compare(spark, con, QUERIES[name], SQL[name], SF_DIR)
    assert problem in (None, "both sides empty")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
