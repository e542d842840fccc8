"""Streaming operators: late data, replays, tracked-set changes, stream = batch."""

import datetime as dt
import os
import tempfile

from vantage.streaming import ingest as IG
from vantage.streaming import lifecycle as LC


def _t(s):
    return dt.datetime.fromisoformat(s)


def _write(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, name))


POLL = "streamer_id long, viewer_count int, category_id long, follower_count long, event_time timestamp_ntz, event_id long"


def _run(df, spark, **opts):
    return IG.run_available_now(df, spark).collect()


def test_late_poll_within_watermark_counts_later_dropped(spark):
    """A sample up to 60 s late still lands in its tick; a sample older than the
    watermark of the previous micro-batch is dropped (Spark's late-event rule)."""
    root = tempfile.mkdtemp(prefix="vantage-test-")
    src = os.path.join(root, "in")
    _write(spark, [(1, 10, 5, 100, _t("2024-01-01 12:00:00"), 1)], POLL, src, "b1")
    _write(spark, [(1, 20, 5, 100, _t("2024-01-01 13:00:00"), 2)], POLL, src, "b2")
    _write(
        spark,
        [
            (1, 30, 5, 100, _t("2024-01-01 12:59:30"), 3),  # 30 s late: inside the watermark
            (1, 40, 5, 100, _t("2024-01-01 11:40:00"), 4),  # far behind every watermark: dropped
            (1, 50, 5, 100, _t("2024-01-01 14:00:00"), 5),  # sentinel that closes the 13:00 tick
        ],
        POLL,
        src,
        "b3",
    )
    stream = IG.read_stream(spark, os.path.join(src, "*"), POLL, maxFilesPerTrigger=1)
    rows = {r.tick_end: r for r in _run(IG.poll_ticks(stream, 15), spark)}
    assert rows[_t("2024-01-01 12:15:00")].concurrent_viewers == 10
    assert rows[_t("2024-01-01 13:00:00")].concurrent_viewers == 30
    assert rows[_t("2024-01-01 13:15:00")].concurrent_viewers == 20
    assert _t("2024-01-01 11:45:00") not in rows


def test_dedupe_within_watermark_drops_replays(spark):
    root = tempfile.mkdtemp(prefix="vantage-test-")
    src = os.path.join(root, "in")
    row = (1, 10, 5, 100, _t("2024-01-01 12:00:00"), 1)
    _write(spark, [row], POLL, src, "b1")
    _write(spark, [row, (1, 11, 5, 100, _t("2024-01-01 12:15:00"), 2)], POLL, src, "b2")
    stream = IG.read_stream(spark, os.path.join(src, "*"), POLL, maxFilesPerTrigger=1)
    out = IG.run_available_now(IG.dedupe_within_watermark(stream, ["streamer_id", "event_time"]), spark)
    assert out.count() == 2


def test_tracked_set_is_reread_each_micro_batch(spark):
    root = tempfile.mkdtemp(prefix="vantage-test-")
    src, tracked = os.path.join(root, "in"), os.path.join(root, "tracked")
    chat = "channel string, is_echo boolean, event_time timestamp_ntz, event_id long"
    spark.createDataFrame([(1, "alice")], "streamer_id long, username string").write.parquet(tracked)
    _write(spark, [("Alice", False, _t("2024-01-01 10:00:00"), 1), ("Bob", False, _t("2024-01-01 10:01:00"), 2)], chat, src, "b1")
    stream = IG.read_stream(spark, os.path.join(src, "*"), chat, maxFilesPerTrigger=1)
    root2 = IG.stream_root(spark)
    step = IG.with_fresh_tracked(tracked, IG.idempotent_parquet_sink(os.path.join(root2, "out")))

    def run():
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", os.path.join(root2, "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([(2, "bob")], "streamer_id long, username string").write.mode("append").parquet(tracked)
    _write(spark, [("BOB", False, _t("2024-01-01 10:02:00"), 3), ("bob", True, _t("2024-01-01 10:03:00"), 4)], chat, src, "b2")
    run()
    got = sorted((r.channel, r.streamer_id) for r in spark.read.parquet(os.path.join(root2, "out")).collect())
    assert got == [("Alice", 1), ("BOB", 2)]  # echo dropped; Bob counted once tracked


def test_carry_over_and_tail(spark):
    """Messages carry over a missed poll; messages after the last poll
    are dropped by default and emitted on a final row with keep_tail."""
    ts = lambda m: _t("2024-01-01 10:00:00") + dt.timedelta(minutes=m)
    chat = spark.createDataFrame(
        [(7, ts(1), 1), (7, ts(2), 2), (7, ts(20), 3), (7, ts(40), 4), (7, ts(41), 5)],
        "broadcast_id long, event_time timestamp_ntz, event_id long",
    )
    polls = spark.createDataFrame([(7, ts(15), 10), (7, ts(30), 11)], "broadcast_id long, event_time timestamp_ntz, event_id long")
    got = {r.poll_event_id: r.chat_messages_delta for r in LC.chat_delta_carry_over(chat, polls).collect()}
    assert got == {10: 2, 11: 1}
    tail = {r.poll_event_id: r.chat_messages_delta for r in LC.chat_delta_carry_over(chat, polls, keep_tail=True).collect()}
    assert tail == {10: 2, 11: 1, None: 2}
