"""The queries that SQL can express, against their SQL in DuckDB."""

import pytest
from compare import connect, same

from quantloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf).toPandas(), connect(sf).sql(queries.oracle_sql()[name]).df())
