"""Nested-histogram percentiles equal Spark's exact ``percentile``."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vantage.operators.metrics import describe
from vantage.operators.quantiles import exact_percentiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        rows.append(
            (
                rng.gauss(0, 1),
                float(rng.choice([1, 2, 2, 2, 3])),  # ties
                None if k % 3 else rng.random(),  # missing
                7.5,  # one value
                10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]),  # scales
                None,
                math.inf if k % 50 == 0 else -math.inf if k % 70 == 0 else float(k),
                math.nan if k % 4 == 0 else float(k % 11),
                k // 1000,
            )
        )
    schema = ", ".join(f"c{i} double" for i in range(8)) + ", c8 int"
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("bins", [16, 512])
def test_equal_to_percentile(table, bins):
    cols = table.columns
    got = exact_percentiles(table, cols, SHARES, bins=bins)
    for c in cols:
        x = F.col(c).cast("double")
        want = table.where(x.isNotNull() & ~F.isnan(x)).agg(F.percentile(x, SHARES)).first()[0]
        assert got[c] == (want if want is not None else [None] * len(SHARES)), c


def test_no_rows(spark, table):
    assert exact_percentiles(table.limit(0), ["c0"], [0.5]) == {"c0": [None]}


def test_partial_counts_are_bounded(table):
    """Every pass is a partial aggregation of at most bins + 2 rows per range, never one
    row per distinct value, and heavy tails take few passes."""
    passes = []
    collect = type(table).collect

    def spy(df):
        passes.append((df._jdf.queryExecution().executedPlan().toString(), collect(df)))
        return passes[-1][1]

    type(table).collect = spy
    try:
        exact_percentiles(table, ["c4"], [0.5], bins=64)
    finally:
        type(table).collect = collect
    passes = [(plan, rows) for plan, rows in passes if rows and "bin" in rows[0].__fields__]
    assert 2 <= len(passes) <= 8
    assert all("partial_count(1)" in plan and "ercentile" not in plan and len(rows) <= 2 * 66 for plan, rows in passes)


def test_describe(table):
    d = {r.feature: r for r in describe(table, ["c0", "c2", "c5", "c7"]).collect()}
    assert d["c2"]["count"] == 1000 and d["c5"]["count"] == 0 and d["c5"].p50 is None
    assert d["c7"]["count"] == 2250 and d["c7"]["max"] == 10
    assert d["c0"].p25 == table.agg(F.percentile("c0", 0.25)).first()[0]
