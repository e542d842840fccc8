"""Library operators without a registered query: file IO, lookups, renames,
bootstrap, session close, tick validation."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vantage.functions.scalar import id_from_string, parse_date, percent_change, split_list, text_prefix, with_default
from vantage.operators import lookups as Lk
from vantage.operators import writes as W
from vantage.operators.ml import RAW_FEATURES
from vantage.sources import files as Fi
from vantage.streaming.lifecycle import validate_tick


def test_scoring_csv_roundtrip_and_missing_columns(spark):
    d = tempfile.mkdtemp(prefix="vantage-test-")
    good = os.path.join(d, "in.csv")
    cols = ["username"] + list(RAW_FEATURES)
    spark.createDataFrame([("a",) + tuple(float(i) for i in range(8))], ", ".join(f"{c} string" if c == "username" else f"{c} double" for c in cols)).coalesce(1).write.option("header", True).csv(good)
    df = Fi.read_scoring_csv(spark, good)
    assert dict(df.dtypes)["first_30d_avg_viewers"] == "double"
    bad = os.path.join(d, "bad.csv")
    spark.createDataFrame([("a", 1.0)], "username string, total_broadcasts double").write.option("header", True).csv(bad)
    with pytest.raises(ValueError, match="lacks"):
        Fi.read_scoring_csv(spark, bad)
    assert Fi.default_output_path("/x/streamers.csv") == "/x/streamers_predictions.csv"


def test_lookups_and_sets(spark, fixture_tables):
    t = fixture_tables
    assert Lk.entity_by_username(t.streamers, "RISING_BOB").first().streamer_id == 1002
    assert Lk.entity_by_id(t.streamers, 1003).count() == 1
    tracked = t.streamers.select("username")
    added = spark.createDataFrame([("NEW_ONE",), ("rising_bob",)], "username string")
    assert Lk.tracked_union(tracked, added).count() == 6
    assert Lk.tracked_difference(tracked, spark.createDataFrame([("Rising_Bob",)], "username string")).count() == 4


def test_rename_stats_both_ways(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "streamer_id long, total_streaming_hours double, peak_viewers_30d int")
    c = Lk.rename_stats(df)
    assert {"total_broadcast_hours", "max_concurrent_viewers"} <= set(c.columns)
    assert {"total_streaming_hours", "peak_viewers_30d"} <= set(Lk.rename_stats(c, to="ddl").columns)


def test_bootstrap_only_without_active(spark, fixture_tables):
    t = fixture_tables
    names = spark.createDataFrame([("Alpha",)], "username string")
    profiles = spark.createDataFrame([(9, "alpha", "Alpha"), (10, "beta", "Beta")], "streamer_id long, username string, display_name string")
    assert W.bootstrap_entities(t.streamers, names, profiles, "2025-11-01 00:00:00").count() == 5
    empty = t.streamers.withColumn("is_active", F.lit(False))
    out = W.bootstrap_entities(empty, names, profiles, "2025-11-01 00:00:00")
    assert out.count() == 6 and out.filter("streamer_id = 9 AND is_active").count() == 1


def test_close_sessions_newest_open(spark):
    b = spark.createDataFrame(
        [(1, 7, dt.datetime(2024, 1, 1, 10), None, None), (2, 7, dt.datetime(2024, 1, 1, 11), None, None)],
        "broadcast_id long, streamer_id long, started_at timestamp_ntz, ended_at timestamp_ntz, duration_seconds int",
    )
    off = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 12, 0, 0, 600000))], "streamer_id long, event_time timestamp_ntz")
    got = {r.broadcast_id: r for r in W.close_sessions(b, off).collect()}
    assert got[2].ended_at == dt.datetime(2024, 1, 1, 12, 0, 0, 600000) and got[2].duration_seconds == 3601
    assert got[1].ended_at is None  # older open session stays open (orphan)


def test_tick_validation():
    assert validate_tick(15) == 15 and validate_tick(360) == 360
    for bad in (0, 7, 45, 90):
        with pytest.raises(ValueError):
            validate_tick(bad)


def test_scalar_helpers(spark):
    df = spark.createDataFrame([("12", "2024-01-05", " a, ,b ,", None, "x" * 70)], "s string, d string, l string, n string, long string")
    r = df.select(
        id_from_string("s").alias("i"),
        id_from_string(F.lit("")).alias("e"),
        parse_date("d").alias("d"),
        parse_date(F.lit("2024-1-5")).alias("bad"),
        split_list("l").alias("l"),
        with_default("n", "Untitled Stream").alias("t"),
        text_prefix("long").alias("p"),
        text_prefix("n").alias("na"),
        percent_change(F.lit(15), F.lit(10)).alias("pc"),
        percent_change(F.lit(15), F.lit(0)).alias("pc0"),
    ).first()
    assert r.i == 12 and r.e is None and r.d == dt.date(2024, 1, 5) and r.bad is None
    assert r.l == ["a", "b"] and r.t == "Untitled Stream" and len(r.p) == 60 and r.na == "N/A"
    assert r.pc == pytest.approx(50.0) and r.pc0 is None


def test_apply_defaults_and_small_writers(spark):
    from vantage.operators.filters import validate_range

    df = spark.createDataFrame([(1, None, None)], "streamer_id long, is_active boolean, chat_messages_delta int")
    r = W.apply_defaults(df, {"is_active": F.lit(True), "chat_messages_delta": F.lit(0)}).first()
    assert r.is_active is True and r.chat_messages_delta == 0
    d = tempfile.mkdtemp(prefix="vantage-test-")
    Fi.write_importance(spark, [("a", 0.7), ("b", 0.3)], os.path.join(d, "imp"))
    assert spark.read.option("header", True).csv(os.path.join(d, "imp")).count() == 2
    Fi.write_report(spark.createDataFrame([("1", 0.5)], "class string, f1 double"), os.path.join(d, "rep"))
    assert spark.read.json(os.path.join(d, "rep")).first()["f1"] == 0.5
    for bad in ((-1, 5, 1), (5, 4, 1), (0, 5, 0)):
        with pytest.raises(ValueError):
            validate_range(*bad)
