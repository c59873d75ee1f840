import pytest

import __spark_entry__ as entry
from effectlens.plans import catalogue
from tests.against import SF, assert_same, duck


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["spline_v_1d", "spline_v_2d", "spline_v_stacked"])
def test_spline_queries_give_one_row_for_each_group(spark, name):
    out = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(out) == out.l_linestatus.nunique()
    assert ((out.gii**2 - out.m * out.v).abs() < 0.01 * out.m * out.v + 1e-6).all()


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
