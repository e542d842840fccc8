"""Constraint violations (W7-W9) and training-set boundaries."""

import datetime as dt

from vantage.operators import quality as Qa
from vantage.operators.ml import LABEL, training_set
from vantage.sources.fixture import load_fixture
from vantage.sources.tables import STATS_SCHEMA


def test_violations_are_quarantined(spark):
    bad_sessions = [
        (20, 1001, 2001, "t", "2025-10-20 10:00:00", "2025-10-20 09:00:00", 100, None, None, None, 1),  # ends before start
        (21, 1001, 9999, "t", "2025-10-20 10:00:00", None, 0, -5, None, None, 1),  # zero duration, negative viewers, orphan category
        (22, 4242, 2001, "t", "2025-10-20 10:00:00", None, None, None, None, None, 1),  # orphan entity
    ]
    bad_snaps = [(1, 1001, 2001, "2025-10-20 14:00:00", 1, 1, 1, 0)]  # duplicates an existing (session, time) key
    t = load_fixture(spark, bad_sessions, bad_snaps)
    _, q = Qa.validate_checks(t.broadcasts(), Qa.CHECKS["broadcasts"])
    got = {r.broadcast_id: set(r.failed_checks) for r in q.collect()}
    assert got == {
        20: {"check_broadcast_times"},
        21: {"check_duration_positive", "check_metrics_non_negative"},
    }
    dups = Qa.duplicate_keys(t.snapshots, ["broadcast_id", "snapshot_timestamp"]).collect()
    assert [(r.broadcast_id, r.occurrences) for r in dups] == [(1, 2)]
    orphans_e = Qa.validate_fk(t.broadcasts(), t.streamers, "streamer_id").select("broadcast_id").collect()
    orphans_c = Qa.validate_fk(t.broadcasts(), t.categories, "primary_category_id", "category_id").select("broadcast_id").collect()
    assert [r.broadcast_id for r in orphans_e] == [22] and [r.broadcast_id for r in orphans_c] == [21]


def test_long_username_violates_length(spark):
    from pyspark.sql import functions as F

    t = load_fixture(spark)
    long = t.streamers.limit(1).withColumn("username", F.lit("u" * 26))
    v = Qa.validate_not_null_length(long, "streamers").first()
    assert "username longer than 25" in v.violations


def _stats(spark, rows):
    full = []
    for sid, d, hours, avg in rows:
        full.append((sid, dt.date.fromisoformat(d), 3, hours, 1.0, avg, 10, 5.0, 1.0, 1, 10, 1000, 1.0))
    return spark.createDataFrame(full, STATS_SCHEMA)


def test_training_set_boundaries(spark):
    s = _stats(
        spark,
        [
            (1, "2025-01-01", 12.0, 100.0), (1, "2025-02-01", 12.0, 17000.0), (1, "2025-03-01", 12.0, 50.0),  # peak exactly at threshold
            (2, "2025-01-01", 10.0, 20000.0), (2, "2025-02-01", 30.0, 20000.0),  # first record has exactly 10 h: excluded
            (3, "2025-01-01", 11.0, 18000.0),  # first record is its own peak: labels itself
            (4, "2025-01-01", 11.0, 16999.99), (4, "2025-02-01", 11.0, 100.0),
        ],
    )
    got = {r.streamer_id: r for r in training_set(s, 17000.0, 10.0).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1][LABEL] == 1 and got[3][LABEL] == 1 and got[4][LABEL] == 0
    assert got[1].first_30d_avg_viewers == 100.0  # features from the first record
    assert got[1].tune_in_ratio == 100.0 / (1000 + 1e-6)


def test_training_set_reads_statistics_once(spark):
    """First record and peak share a pass, and neither the sort nor a second reader repeats it."""
    s = _stats(spark, [(k, "2025-01-01", 12.0, 100.0) for k in range(20)] + [(k, "2025-02-01", 12.0, 17000.0) for k in range(20)])
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = training_set(s.mapInArrow(counted, s.schema), 17000.0, 10.0)
    assert [r.streamer_id for r in found.collect()] == list(range(20))
    assert found.filter(f"{LABEL} = 1").count() == 20
    assert read.value == 40
