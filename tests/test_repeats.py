"""Line items whose keys repeat: plans that keep an item in one row must still treat its rows as SQL does."""

import os

import pytest

from verdikt.plans import registry

from .compare import connection, table


@pytest.fixture(scope="module")
def repeated(data, tmp_path_factory):
    """The smallest tables, with some line items twice and some again at another price."""
    d = tmp_path_factory.mktemp("repeats")
    for f in os.listdir(data):
        if f != "lineitem.parquet":
            os.symlink(f"{data}/{f}", d / f)
    x, k = f"'{data}/lineitem.parquet'", "l_orderkey % 40"
    again = f"select * from {x} where {k} = 1 union all select * replace (l_extendedprice + 1 as l_extendedprice) from {x} where {k} = 2"
    connection(data).execute(f"copy (select * from {x} union all {again}) to '{d}/lineitem.parquet' (format parquet)")
    return str(d)


@pytest.mark.parametrize("name", ["x22_gate_areas", "x22_gate_verdicts", "x21_speed_rules", "x25_rendering_table", "x25_rendering_pairs"])
def test_repeated_items_equal_sql(spark, repeated, name):
    got = table(registry.queries()[name](spark, repeated).toPandas())
    assert got == table(connection(repeated).sql(registry.oracle_sql()[name]).df())
