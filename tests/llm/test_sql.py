import pytest

from cellfold.llm.queries import ORACLES, QUERIES

from tests.conftest import SF, comparable


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert comparable(QUERIES[name](spark, SF).toPandas()) == comparable(duck.sql(ORACLES[name]).df())
