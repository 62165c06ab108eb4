import pytest
from oracle import connect, rows_of, rows_of_sql

from loomary.plans import coverage, integrity, reference

ALL = {k: (f, m.ORACLE.get(k)) for m in (reference, coverage, integrity) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_sql(spark, data, name):
    f, sql = ALL[name]
    got = rows_of(f(spark, data))
    if sql:
        assert got == rows_of_sql(connect(data), sql)


def test_entry_names_are_unique():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
