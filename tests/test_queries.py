import pytest

import __spark_entry__ as entry_point
from compare import connect, differences

from conftest import SMALL

QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_entry(spark):
    row = entry_point.entry(spark).first()
    assert row.n > 0 and 0 < row.qwk < 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SMALL), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, SMALL).isEmpty()
