import pytest
from compare import assert_equal

from convlake.llm import queries

SQL = queries.oracle_sql()


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert names[0] == "pipeline" and set(names[1:]) == {n for n in names if n.startswith("op")}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert_equal(spark, sf, queries.queries()[name], SQL[name])
