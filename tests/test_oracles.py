"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import pytest

from verdikt.plans import registry

from .compare import connection, table

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, data, name):
    got = table(registry.queries()[name](spark, data).toPandas())
    want = table(con.sql(SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_gives_rows(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() == 6
    assert set(out.columns) == {"task", "eps", "cut", "n", "handled", "coverage", "error", "held"}
