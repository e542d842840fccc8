"""V8 from day summaries: equal to Q8 date by date, rows independent of the window."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vantage.operators import aggregates as A
from vantage.operators import sliding as S

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    sessions, snaps = [], []
    for entity in range(1, 8):
        for k in range(0 if entity == 7 else 40):
            start = T0 + dt.timedelta(minutes=rng.randrange(120 * 1440))
            sessions.append((entity, start, start + dt.timedelta(minutes=rng.randrange(10, 600)) if rng.random() < 0.9 else None))
            for j in range(rng.randrange(5)):
                v = None if rng.random() < 0.1 else rng.randrange(12)
                cat = None if rng.random() < 0.2 else rng.randrange(5)
                snaps.append((entity, start + dt.timedelta(minutes=15 * j), v, rng.randrange(9), cat, None if rng.random() < 0.1 else rng.randrange(900)))
    snaps.append((7, T0, 5, 5, 5, 5))  # snapshots, but no session
    streamers = spark.createDataFrame([(e, e != 6) for e in range(1, 9)], "streamer_id long, is_active boolean")
    b = spark.createDataFrame(sessions, "streamer_id long, started_at timestamp_ntz, ended_at timestamp_ntz")
    s = spark.createDataFrame(
        snaps, "streamer_id long, snapshot_timestamp timestamp_ntz, concurrent_viewers int, chat_messages_delta int, category_id long, follower_count long"
    )
    return streamers, b, s


def rounded(df):
    return {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}


@pytest.mark.parametrize("step,window", [(1, 30), (7, 10), (30, 90)])
def test_equal_to_one_date_at_a_time(tables, step, window):
    streamers, b, s = tables
    first, last = "2024-01-20", "2024-04-10"
    history = A.stats_history(streamers, b, s, first, last, step, window).cache()
    dates = [dt.date.fromisoformat(first) + dt.timedelta(days=k) for k in range(0, 82, step)]
    assert {r.d for r in history.select(F.col("calculation_date").alias("d")).distinct().collect()} <= set(dates)
    for d in dates[:: max(1, len(dates) // 4)]:
        want = A.rolling_statistics(streamers, b, s, d.isoformat(), window)
        assert rounded(history.where(F.col("calculation_date") == d).select(*want.columns)) == rounded(want)
    history.unpersist()


def test_rows_do_not_grow_with_the_window(tables):
    """The day axis holds a row per entity and day, and one per result."""
    streamers, b, s = tables
    sess = b.where("ended_at IS NOT NULL").withColumn("duration_hours", F.lit(1.0))
    days = sess.select("streamer_id", F.to_date("started_at")).distinct().count()
    for window in (5, 50):
        axis = S.session_days(sess, "2024-01-20", "2024-04-10", 1, window)
        dates = axis.where("entry.is_date")
        assert axis.count() - dates.count() == days
        assert dates.count() == dates.select("streamer_id", "entry.day").distinct().count()


def test_median_of_counts(spark):
    rows = [([(3, 2), (1, 1), (3, 1)], 4), ([(5, 1)], 1), ([(1, 2), (4, 2)], 4), ([], 0)]
    df = spark.createDataFrame(rows, "c array<struct<v:int,n:bigint>>, total long")
    got = [r.m for r in df.select(S.median_of_counts(F.col("c"), F.nullif("total", F.lit(0))).alias("m")).collect()]
    assert got == [3.0, 5.0, 2.5, None]
