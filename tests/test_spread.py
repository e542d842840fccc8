"""Steps whose groups are nearly as many as their rows take a number of tasks that grows
with the rows (F6, F7, F18), with the results of a plan left to Spark."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vantage.operators import joins as J
from vantage.plans import queries as Q
from vantage.sources.tables import DriverTables

AS_OF = "2000-01-01"
SPARSE_AS_OF = "1999-10-01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Own rows: repeated and null keys, and entities and categories without a match."""
    root = str(tmp_path_factory.mktemp("spread"))
    at = F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00' + make_dt_interval(CAST(id % 300 AS INT))")
    none = lambda c, n: F.when(F.col("id") % n != n - 1, c)
    made = {
        "customer": spark.range(40).select(
            none(F.col("id"), 19).alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), (F.col("id") - 5.0).alias("c_acctbal"),
            F.lit("MACHINERY").alias("c_mktsegment"),
        ),
        "part": spark.range(30).select(
            (F.col("id") % 25).alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 4).alias("p_brand"), F.lit("T").alias("p_type"),
            (F.col("id") * 2).cast("int").alias("p_size"),
        ),
        "orders": spark.range(300).select(
            none(F.col("id") % 290, 50).alias("o_orderkey"), none(F.col("id") % 45, 31).alias("o_custkey"),
            F.when(F.col("id") % 3 == 0, "O").otherwise("F").alias("o_orderstatus"), (F.col("id") * 731.5).alias("o_totalprice"),
            at.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
        ),
        "lineitem": spark.range(2000).select(
            none(F.col("id") % 310, 97).alias("l_orderkey"), none(F.col("id") * 7 % 27, 61).alias("l_partkey"),
            (F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") * 11.5).alias("l_extendedprice"), at.alias("l_shipdate"),
        ),
    }
    for name, df in made.items():
        df.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return DriverTables(spark, root)


def _rows(df):
    return sorted(map(repr, df.collect()))


QUERIES = {
    "q2": lambda t: Q.q2_category_independent(t, AS_OF, 730),
    "q3": lambda t: Q.q3_hype_dependency(t),
    "q3_session": lambda t: Q.q3_hype_dependency(t, fanout="session"),
    "p8": lambda t: Q.p8_sparse_keys(t, SPARSE_AS_OF),
}


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_over_many_tasks(tables, monkeypatch, name):
    plain = _rows(QUERIES[name](tables))
    assert plain
    monkeypatch.setattr(J, "ROWS_PER_TASK", 100)
    assert _rows(QUERIES[name](tables)) == plain


def test_tasks_grow_with_the_rows(tables, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_TASK", 100)
    snapshots, tasks = tables.spread_snapshots()
    assert tasks == 20 and snapshots.rdd.getNumPartitions() == 20
    assert J.task_count(401) == 5 and J.task_count(400) == 0


def test_order_over_many_tasks(tables, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_TASK", 100)
    found = [(r.username, not r.is_trending, -r.avg_viewers, r.category_name) for r in Q.q3_hype_dependency(tables).collect()]
    assert found == sorted(found) and len(found) > 100


def test_sparse_keys_are_counted_where_their_session_is_dealt(tables, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_TASK", 100)
    plan = Q.p8_sparse_keys(tables, SPARSE_AS_OF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((?:l_orderkey|o_orderkey|broadcast_id)#\d+L?, (\d+)\)", plan)
    assert dealt and set(dealt) == {"20"}
    assert "hashpartitioning(predicate" not in plan


@pytest.mark.parametrize("rows_per_task", [100, J.ROWS_PER_TASK])
def test_sparse_keys_count_repeated_and_null_keys(tables, monkeypatch, rows_per_task):
    monkeypatch.setattr(J, "ROWS_PER_TASK", rows_per_task)
    sessions, snapshots = tables.broadcasts().collect(), tables.snapshots.collect()
    seen = {r.broadcast_id for r in snapshots if r.concurrent_viewers is not None}
    expected = {
        ("live_sessions", "broadcasts"): Counter(r.broadcast_id for r in sessions if r.ended_at is None),
        ("has_peak", "broadcasts"): Counter(r.broadcast_id for r in sessions if r.broadcast_id in seen),
        ("busy_chat", "broadcast_snapshots"): Counter(r.broadcast_id for r in snapshots if (r.chat_messages_delta or 0) > 100),
        ("active", "streamers"): Counter(r.streamer_id for r in tables.streamers.collect() if r.is_active),
        ("trending", "categories"): Counter(r.category_id for r in tables.categories.collect() if r.is_trending),
    }
    found: dict[tuple, Counter] = {}
    rows = Q.p8_sparse_keys(tables, SPARSE_AS_OF).collect()
    for r in rows:
        found.setdefault((r.predicate, r.table_name), Counter())[r.id] += r.row_count
    assert len({r[:3] for r in rows}) == len(rows)
    assert {k: found[k] for k in expected if expected[k]} == {k: c for k, c in expected.items() if c}
    assert {"positive_velocity", "positive_consistency"} <= {p for p, _ in found}
    assert None in found["live_sessions", "broadcasts"] and max(found["live_sessions", "broadcasts"].values()) > 1
