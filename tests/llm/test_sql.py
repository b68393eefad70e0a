import pytest

from tempolink.llm import queries

from ..test_queries import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    same(spark, small, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
