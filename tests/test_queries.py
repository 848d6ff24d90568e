import pytest
from compare import assert_equal

import __spark_entry__
from convlake.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_equal(spark, sf, QUERIES[name], SQL[name])


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
