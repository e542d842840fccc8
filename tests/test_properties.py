"""Properties of the write, merge and split operators (SURVEY §5 (3))."""

import datetime as dt

from pyspark.sql import functions as F

from vantage.operators import writes as W
from vantage.operators.aggregates import rolling_statistics
from vantage.plans import queries as Q
from vantage.sources.fixture import load_fixture

AS_OF = "2025-10-29"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_stats_is_idempotent(fixture_tables):
    t = fixture_tables
    target = rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, "2025-10-27", 30)
    fresh = rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30)
    once = W.upsert_stats(target, fresh, "2025-10-30 02:00:00")
    twice = W.upsert_stats(once, fresh, "2025-10-30 02:00:00")
    assert _rows(once) == _rows(twice)
    assert once.count() == target.count() + fresh.count()  # different dates: all inserted


def test_upsert_stats_keeps_created_at(spark, fixture_tables):
    t = fixture_tables
    fresh = rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30)
    first = W.upsert_stats(fresh.limit(0).withColumn("created_at", F.lit(None).cast("timestamp_ntz")), fresh, "2025-10-30 02:00:00")
    again = W.upsert_stats(first, fresh, "2025-10-31 02:00:00")
    row = again.filter("streamer_id = 1001").first()
    assert row["created_at"] == dt.datetime(2025, 10, 30, 2, 0)
    assert row["updated_at"] == dt.datetime(2025, 10, 31, 2, 0)


def test_archive_split_is_a_disjoint_cover(fixture_tables):
    s = fixture_tables.snapshots
    archive, live = W.archive_split(s, "2025-10-25 00:00:00")
    assert archive.count() + live.count() == s.count()
    assert archive.unionByName(live).exceptAll(s).count() == 0
    assert archive.intersect(live).count() == 0


def test_insert_ignore_partitions_its_input(spark, fixture_tables):
    s = fixture_tables.snapshots
    dup = s.unionByName(s.filter("broadcast_id = 6"))  # repeats inside the batch
    stored = s.filter("broadcast_id = 1")
    inserted, skipped = W.insert_ignore(stored, dup, ["broadcast_id", "snapshot_timestamp"])
    assert inserted.count() + skipped.count() == dup.count()
    assert inserted.filter("broadcast_id = 1").count() == 0
    assert inserted.groupBy("broadcast_id", "snapshot_timestamp").count().filter("count > 1").count() == 0


def test_fanout_modes_agree_with_one_snapshot_per_session(spark, fixture_tables):
    t = fixture_tables
    one = t.snapshots.filter(F.col("stream_uptime_seconds") == 0)  # first snapshot of each session only
    from vantage.sources.tables import DomainTables

    t1 = DomainTables(t.streamers, t.categories, t.broadcasts(), one)
    a = _rows(Q.q4_follower_velocity(t1, as_of=AS_OF, days=30, fanout="reference"))
    b = _rows(Q.q4_follower_velocity(t1, as_of=AS_OF, days=30, fanout="session"))
    assert a == b


def test_range_gain_bounds_net_gain(spark):
    drop = [(1, 1001, 2001, "2025-10-20 14:45:00", 100, 4900, 10, 2700)]  # follower drop, later in session 1
    t = load_fixture(spark, extra_snapshots=drop)
    rng = {r["streamer_id"]: r["follower_gain_30d"] for r in rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30).collect()}
    net = {r["streamer_id"]: r["follower_gain_30d"] for r in rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30, follower_mode="net").collect()}
    for k in rng:
        assert rng[k] >= abs(net[k])
    assert rng[1001] == 145 and net[1001] == 45


def test_window_bounds_are_half_open(spark):
    sess = [
        (9, 1005, None, "t", "2025-09-29 00:00:00", "2025-09-29 01:00:00", 3600, None, None, None, 5),  # as_of - 30d: in
        (10, 1005, None, "t", "2025-10-30 00:00:00", "2025-10-30 01:00:00", 3600, None, None, None, 5),  # as_of + 1d: out
    ]
    t = load_fixture(spark, extra_sessions=sess)
    got = {r["streamer_id"]: r for r in rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30).collect()}
    assert got[1005]["total_broadcasts"] == 1
