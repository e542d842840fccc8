"""Cases in which rows, ids or rules used to be lost."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vantage.operators import quality as Qa
from vantage.operators import writes as W
from vantage.plans import jobs
from vantage.plans import queries as Q
from vantage.sources import landing as L
from vantage.sources.tables import DomainTables, DriverTables
from vantage.streaming import ingest as IG
from vantage.streaming import lifecycle as LC

SF = "/root/testdata/sf0.001"
LIFE = "kind string, streamer_id long, event_time timestamp_ntz, event_id long, title string, category_id long"


def at(minute):
    return dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute)


def test_long_user_ids_stay_apart(spark):
    ids = spark.createDataFrame([(1234567890,), (1234567899,), (42,)], "u long")
    names = [r[0] for r in ids.select(L.display_login(F.col("u"))).collect()]
    assert names == ["Customer#1234567890", "Customer#1234567899", "Customer#000000042"]


def test_check_rule_with_missing_columns(spark):
    df = spark.createDataFrame([(1, -5), (2, 5), (3, None)], "broadcast_id long, peak_viewers int")
    rules = {"check_metrics_non_negative": Qa.CHECKS["broadcasts"]["check_metrics_non_negative"]}
    valid, bad = Qa.validate_checks(df, rules)
    assert [r.broadcast_id for r in bad.collect()] == [1] and valid.columns == df.columns
    with pytest.raises(ValueError, match="names no column"):
        Qa.validate_checks(df, Qa.CHECKS["broadcasts"])


def test_every_offline_closes_a_session(spark):
    b = spark.createDataFrame(
        [(1, 7, at(0), None, None), (2, 7, at(5), None, None), (3, 7, at(9), at(9), 0), (4, 8, at(0), None, None)],
        "broadcast_id long, streamer_id long, started_at timestamp_ntz, ended_at timestamp_ntz, duration_seconds int",
    )
    off = spark.createDataFrame([(7, at(6)), (7, at(8)), (7, at(20)), (8, at(-1))], "streamer_id long, event_time timestamp_ntz")
    got = {r.broadcast_id: (r.ended_at, r.duration_seconds) for r in W.close_sessions(b, off).collect()}
    assert got == {2: (at(6), 60), 1: (at(8), 480), 3: (at(9), 0), 4: (None, None)}


def test_sessions_of_one_instant_have_own_ids(spark):
    life = spark.createDataFrame([("online", 1, at(0), 10, None, None), ("online", 1, at(0), 11, None, None)], LIFE)
    assert LC.sessionize_batch(life).select("broadcast_id").distinct().count() == 2
    assert W.create_sessions(life).select("broadcast_id").distinct().count() == 2


def test_messages_of_a_missed_poll_carry_over(spark):
    schema = "broadcast_id long, streamer_id long, event_time timestamp_ntz, event_id long, started_at timestamp_ntz"
    chat = spark.createDataFrame([(1, 1, at(m), 100 + m, at(0)) for m in (2, 20, 21, 50)], schema)
    polls = spark.createDataFrame(
        [(1, 1, at(m), m, at(0), v, 1, 1) for m, v in ((1, 5), (25, None), (40, 7))],
        schema + ", viewer_count int, category_id long, follower_count long",
    )
    got = {r.concurrent_viewers: r.chat_messages_delta for r in LC.snapshot_ticks(polls, chat, 15).collect()}
    assert got == {5: 0, 7: 3}


def test_snapshot_messages_equal_the_carry_over(spark):
    t = DriverTables(spark, SF)
    total = lambda df: df.agg(F.sum("chat_messages_delta")).first()[0]
    assert total(Q.s6_snapshot_ticks(t)) == total(Q.s5_chat_delta_carry_over(t))


def test_the_last_tick_is_there(spark):
    t = DriverTables(spark, SF)
    assert Q.s15_stream_poll_outcomes(t).count() == Q.s15_poll_outcomes(t).count()


def test_a_stream_without_input_is_empty(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    stream = IG.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], LIFE).schema)
    assert IG.run_available_now(stream, spark).count() == 0


def test_a_user_listed_twice_is_added_once(spark):
    people = spark.createDataFrame([(9, "z", "Z", True)], "streamer_id long, username string, display_name string, is_active boolean")
    listing = spark.createDataFrame(
        [(1, 5, 50, 0), (1, 5, 50, 1), (2, 5, 50, 2), (1, 6, 50, 3), (1, 9, 50, 4)],
        "game_id long, user_id long, viewer_count int, listing_pos long",
    )
    profiles = spark.createDataFrame([(5, "a", "A"), (6, "b", "B"), (9, "z", "Z")], "streamer_id long, username string, display_name string")
    tables = DomainTables(people, None, None, None)
    new, summary = jobs.discovery_job(tables, listing, profiles, 1, 100, 2, "2024-01-01 00:00:00")
    assert sorted(r.streamer_id for r in new.collect()) == [5, 6]
    assert {r.game_id: (r.processed, r.added) for r in summary.collect()} == {1: (2, 2), 2: (1, 1)}


def test_registered_branches_have_rows(spark):
    t = DriverTables(spark, SF)
    assert Q.q20_discovery_summary(t).agg(F.min("added"), F.sum("added"), F.sum("skipped")).first()[1:] > (0, 0)
    r = Q.q21_bulk_add_summary(t).first()
    assert r.added > 0 and r.skipped > 0 and r.not_found > 0
    for q in (Q.w7_quarantine, Q.w8_entity_violations, Q.w9_orphans):
        assert q(t).count() > 0
    assert Q.w17_maintain_categories(t).filter("category_name = 'Unknown'").count() > 0
    assert Q.w2_upsert_entities(t).filter("updated_at IS NOT NULL").count() > 0
