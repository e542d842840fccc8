"""The live service: out-of-order arrivals, restarts, expiry, tracked-set changes,
replayed rows, and equality with the batch twins."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vantage.sources import landing as L
from vantage.streaming import ingest as IG
from vantage.streaming import lifecycle as LC
from vantage.streaming import service as SV
from vantage.streaming import sessions as S

SF = "/root/testdata/sf0.001"
DAY = "2024-01-01 "


def at(text):
    return dt.datetime.fromisoformat(text if len(text) > 10 else DAY + text)


def ev(kind, when, event_id, login="ann", **values):
    v = {"title": None, "category_id": None, "viewer_count": None, "follower_count": None} | values
    return (login, {"ann": 1, "bob": 2}.get(login), kind, at(when), event_id, *v.values())


CLOCK = (None, None, "clock", at("2024-03-01 00:00:00"), None, None, None, None, None)


class Live:
    """A service fed one micro-batch after another, each by a run that resumes the last."""

    def __init__(self, spark, **options):
        self.spark, self.root, self.options = spark, IG.stream_root(spark), options

    def track(self, login, when, tracked=True):
        rows = self.spark.createDataFrame([({"ann": 1, "bob": 2}[login], login.upper())], "streamer_id long, username string")
        SV.write_tracked(self.root, rows, at(when), tracked)

    def push(self, *rows):
        self.spark.createDataFrame(list(rows), S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/landing")
        stream = IG.read_stream(self.spark, f"{self.root}/landing", S.EVENT_SCHEMA)
        SV.collect(self.spark, stream, self.root, **self.options)

    def rows(self, record, *columns):
        found = SV.records(self.spark, self.root).where(F.col("record") == record)
        return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


def test_late_online_is_opened_before_a_newer_offline(spark):
    live = Live(spark)
    live.push(ev("offline", "10:00:40", 2), ev("chat", "10:00:20", 3))
    live.push(ev("online", "10:00:10", 1))  # late, inside the watermark
    live.push(CLOCK)
    s = SV.sessions_table(spark, live.root).collect()
    assert [(r.started_at, r.ended_at, r.duration_seconds, r.stream_title) for r in s] == [(at("10:00:10"), at("10:00:40"), 30, "Untitled Stream")]
    assert live.rows("dropped", "event_id") == []


def test_stack_over_restarts_and_same_instant(spark):
    """The newest open session closes first; what is open survives the runs; a replayed
    row counts once; rows of one instant go by id, samples before messages."""
    live = Live(spark)
    live.track("ann", "00:00:00")
    live.push(ev("online", "10:00:00", 1, title="a", category_id=5), ev("online", "10:05:00", 2), ev("chat", "10:06:00", 3))
    poll = ev("poll", "10:10:00", 5, viewer_count=9, follower_count=None, category_id=7)
    live.push(ev("chat", "10:10:00", 4), poll, poll, ev("poll", "10:11:00", 6), ev("chat", "10:12:00", 7))
    live.push(ev("offline", "11:00:00", 8), ev("chat", "11:00:00", 9), ev("offline", "12:00:00", 10), ev("offline", "13:00:00", 11))
    live.push(CLOCK)
    s = {r.started_at: r for r in SV.sessions_table(spark, live.root).collect()}
    assert (s[at("10:05:00")].ended_at, s[at("10:00:00")].ended_at) == (at("11:00:00"), at("12:00:00"))
    assert s[at("10:00:00")].primary_category_id == 5 and s[at("10:00:00")].duration_seconds == 7200
    # the failed sample (6) reads nothing; message 4 is not in the sample of its instant
    assert live.rows("sample", "event_id", "messages") == [(5, 1)]
    assert live.rows("tail", "started_at", "messages") == [(at("10:00:00"), 1), (at("10:05:00"), 2)]
    assert live.rows("dropped", "event_id") == [(11,)]
    snaps = SV.snapshots_table(spark, live.root).collect()
    assert [(r.snapshot_timestamp, r.concurrent_viewers, r.follower_count, r.chat_messages_delta, r.stream_uptime_seconds) for r in snaps] == [
        (at("10:15:00"), 9, 0, 1, 600)
    ]
    row = SV.counters(spark.newSession(), live.root).collect()[0]
    assert (row.login, row.opened, row.closed, row.dropped_offline, row.messages, row.samples, row.failed_samples) == ("ann", 2, 2, 1, 4, 1, 1)
    cats = spark.createDataFrame([(3, "three")], "category_id long, category_name string")
    assert {(r.category_id, r.category_name) for r in SV.categories_table(spark, live.root, cats).collect()} == {(3, "three"), (7, "Unknown")}


def test_missed_tick_carries_over(spark):
    live = Live(spark)
    live.track("ann", "00:00:00")
    live.push(ev("online", "10:00:00", 1), ev("chat", "10:01:00", 2), ev("poll", "10:05:00", 3, viewer_count=1))
    live.push(ev("chat", "10:20:00", 4), ev("chat", "10:31:00", 5), ev("poll", "10:40:00", 6, viewer_count=2))
    live.push(ev("poll", "10:44:00", 7, viewer_count=3), ev("chat", "10:44:30", 8), CLOCK)
    live.push(CLOCK)
    got = [(r.snapshot_timestamp, r.concurrent_viewers, r.chat_messages_delta) for r in SV.snapshots_table(spark, live.root).orderBy("snapshot_timestamp").collect()]
    assert got == [(at("10:15:00"), 1, 1), (at("10:45:00"), 3, 2)]


def test_sessions_expire(spark):
    """A session that never closes leaves the state after the parameter, with its tail;
    an offline after that finds nothing."""
    live = Live(spark, max_session_hours=2)
    live.track("ann", "00:00:00")
    live.push(ev("online", "10:00:00", 1), ev("chat", "10:01:00", 2))
    live.push(ev("chat", "11:59:00", 3), ev("chat", "12:00:00", 4), ev("offline", "12:30:00", 5))
    live.push(ev("online", "13:00:00", 6), ev("offline", "13:10:00", 7))
    live.push(CLOCK)
    assert live.rows("expired", "started_at", "event_time") == [(at("10:00:00"), at("12:00:00"))]
    assert live.rows("tail", "started_at", "messages") == [(at("10:00:00"), 2)]
    assert live.rows("dropped", "event_id") == [(5,)]
    assert live.rows("closed", "session_seq") == [(2,)]
    left = spark.read.format("statestore").option("path", f"{live.root}/{SV.CHECKPOINT}").option("stateVarName", "entity").load()
    assert [r.n for r in left.select(F.size("value.started").alias("n")).collect()] == [0]


def test_tracked_set_changes_while_running(spark):
    live = Live(spark)
    live.track("ann", "00:00:00")
    live.push(ev("online", "10:00:00", 1), ev("online", "10:00:00", 2, "bob"), ev("chat", "10:01:00", 3), ev("chat", "10:01:00", 4, "bob"))
    live.track("bob", "10:30:00")
    live.push(ev("chat", "10:40:00", 5), ev("chat", "10:29:59", 6, "bob"), ev("chat", "10:30:00", 7, "bob"))
    live.track("ann", "10:50:00", tracked=False)
    live.track("bob", "2023-12-01 00:00:00")  # older than the watermark: no harm
    live.push(ev("chat", "10:51:00", 8), ev("chat", "10:51:00", 9, "bob"), ev("chat", "10:49:00", 10))
    live.push(CLOCK)
    assert live.rows("message", "streamer_id", "event_id") == [(1, 10), (1, 3), (1, 5), (2, 7), (2, 9)]
    assert {r.login for r in SV.tracked_now(spark, live.root).collect()} == {"bob"}


def test_late_rows_do_not_reach_the_sessions(spark):
    """Beyond the watermark neither lifecycle nor chat rows change anything."""
    live = Live(spark)
    live.track("ann", "00:00:00")
    live.push(ev("online", "10:00:00", 1), ev("chat", "12:00:00", 2))
    live.push(ev("chat", "12:30:00", 3))
    live.push(ev("offline", "10:30:00", 4), ev("chat", "11:00:00", 5))
    live.push(CLOCK)
    assert live.rows("closed", "event_id") == [] and live.rows("message", "event_id") == [(2,), (3,)]


def test_bootstrap_starts_the_tracked_set(spark):
    root = IG.stream_root(spark)
    schema = "streamer_id long, username string, display_name string, is_active boolean, discovered_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
    nobody = spark.createDataFrame([(9, "old", "Old", False, None, None, None)], schema)
    names = spark.createDataFrame([("Ann",), ("ghost",)], "username string")
    profiles = spark.createDataFrame([(1, "ann", "Ann")], "streamer_id long, username string, display_name string")
    SV.bootstrap(spark, root, nobody, names, profiles, "2024-01-01 00:00:00")
    assert [tuple(r) for r in SV.tracked_now(spark, root).collect()] == [("ann", 1)]
    SV.bootstrap(spark, root, nobody, names.limit(0), profiles, "2024-01-02 00:00:00")  # a set exists
    assert [tuple(r) for r in SV.tracked_now(spark, root).collect()] == [("ann", 1)]


def test_settings_are_restored(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with S.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_replay_equals_batch_twins(spark):
    """Out of order over several runs, row for row: sessions, attached messages, snapshots."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    names = events.select(F.col("user_id").alias("streamer_id"), F.lower(L.display_login(F.col("user_id"))).alias("username")).distinct()
    root = IG.stream_root(spark)
    SV.write_tracked(root, names, at("2000-01-01 00:00:00"))
    late = F.expr("make_dt_interval(0, 0, 0, CAST(pmod(hash(event_id), 3600) AS DECIMAL(18, 6)))")
    arrivals = L.service_events(events).withColumn("arrived_at", F.col("event_time") + late)
    SV.replay(spark, arrivals, root, slices=4, watermark="3601 seconds", max_session_hours=24 * 400)

    def same(a, b):
        cols = sorted(b.columns)
        assert a.select(cols).exceptAll(b.select(cols)).count() == 0
        assert b.select(cols).exceptAll(a.select(cols)).count() == 0

    sessions = LC.sessionize_batch(L.lifecycle_events(events))
    same(SV.sessions_table(spark, root), sessions.drop("broadcast_id"))
    life = L.lifecycle_events(events)
    chat = LC.attach_session(LC.filter_chat(L.chat_events(events), names), life, sessions)
    polls = LC.attach_session(L.poll_samples(events), life, sessions)
    attached = S.attached_messages(SV.records(spark, root)).select("event_id", "event_time", "streamer_id", "started_at")
    same(attached, chat.where("broadcast_id IS NOT NULL").select(*attached.columns))
    keys = sessions.select("broadcast_id", "level", "session_seq", "started_at")
    same(SV.snapshots_table(spark, root), LC.snapshot_ticks(polls, chat).join(keys, "broadcast_id").drop("broadcast_id"))
