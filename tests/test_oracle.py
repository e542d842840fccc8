"""Every registered query against its DuckDB oracle on the smallest driver data."""

import os

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck_for

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return duck_for(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    spd = E.queries()[name](spark, SF).toPandas()
    dpd = duck.execute(SQL[name]).df()
    ok, msg = compare(spd, dpd)
    assert ok, msg


def test_every_query_has_rows_or_oracle(spark):
    missing = set(E.queries()) - set(SQL)
    for name in missing:
        E.queries()[name](spark, SF).count()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "streamer_id" in df.columns
