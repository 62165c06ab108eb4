import pytest
from oracle import connect, rows_of, rows_of_sql

from loomary.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, data, name):
    got = rows_of(queries.QUERIES[name](spark, data))
    if name in queries.ORACLE:
        assert got == rows_of_sql(connect(data), queries.ORACLE[name])
