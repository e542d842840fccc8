"""Session lifecycle and snapshot ticks as batch DataFrame jobs.

These are the batch twins (and test oracles) of the streaming operators in
:mod:`vantage.streaming.ingest`.

Lifecycle semantics (reproduced from the ingestion service): every ``online``
opens a session, even if one is open already; every ``offline`` closes the
newest session still open, and is dropped when none is.  That is a stack per
entity, i.e. parenthesis matching:

* running sum ``S`` of +1 (online) / -1 (offline) in time order, and the running
  minimum before each event ``P`` (floored at 0): an offline with ``S < P`` finds
  no open session and is dropped;
* the depth after each kept event is ``S - min(P, S)``; an online at depth ``k``
  is closed by the next event on level ``k`` (always an offline).

Both steps are bucketed ordered passes (:mod:`vantage.operators.sequence`), so a
very active entity is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import seconds_between, uptime_seconds, with_default
from vantage.operators.sequence import day_bucket, running_sum, shift
from vantage.operators.writes import session_key
from vantage.streaming.sessions import DEFAULT_TITLE

ORDER = ["event_time", "event_id"]


def _levels(lifecycle: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Lifecycle rows with ``unmatched`` (dropped offline) and ``level``."""
    x = lifecycle.withColumn("_d", F.when(F.col("kind") == "online", 1).otherwise(-1))
    x = running_sum(x, ["streamer_id"], order or ORDER, "_d", day_bucket("event_time"), out="_S", min_before="_M")
    p_prev = F.least(F.lit(0), F.coalesce(F.col("_M"), F.lit(0)))
    x = x.withColumn("_P", p_prev)
    unmatched = (F.col("kind") == "offline") & (F.col("_S") < F.col("_P"))
    depth = F.col("_S") - F.least(F.col("_P"), F.col("_S"))
    level = F.when(F.col("kind") == "online", depth).otherwise(depth + 1)
    return x.withColumn("unmatched", unmatched).withColumn("level", level).drop("_d", "_S", "_M", "_P")


def sessionize_batch(lifecycle: DataFrame) -> DataFrame:
    """S3 sessions from online/offline events (S1 defaults: title, category).

    Output: broadcast_id (stable hash, W4), streamer_id, level, session_seq
    (k-th session opened on that level), started_at, ended_at, duration_seconds,
    stream_title, primary_category_id."""
    lv = _levels(lifecycle).filter(~F.col("unmatched"))
    nx = shift(lv, ["streamer_id", "level"], ORDER, ["kind", "event_time"], day_bucket("event_time"), "lead")
    ons = nx.filter(F.col("kind") == "online")
    ons = running_sum(
        ons.withColumn("_one", F.lit(1)), ["streamer_id", "level"], ORDER, "_one", day_bucket("event_time"), out="session_seq"
    )
    ended = F.when(F.col("next_kind") == "offline", F.col("next_event_time"))
    return ons.select(
        session_key(F.col("streamer_id"), F.col("event_time"), F.col("level"), F.col("session_seq")).alias("broadcast_id"),
        "streamer_id",
        "level",
        "session_seq",
        F.col("event_time").alias("started_at"),
        ended.alias("ended_at"),
        F.round(seconds_between(F.col("event_time"), ended), 0).cast("int").alias("duration_seconds"),
        with_default("title", DEFAULT_TITLE).alias("stream_title"),
        F.col("category_id").alias("primary_category_id"),
    )


def match_offlines(open_sessions: DataFrame, offline: DataFrame) -> DataFrame:
    """(streamer-wise) the end of each stored open session (broadcast_id, ended_at)
    that an offline event closes: sessions are pushed in start order, an offline pops
    the newest.  Of a session and an offline at one instant, the session is first."""
    on = open_sessions.select(
        "streamer_id", F.col("started_at").alias("event_time"), F.lit(0).alias("_o"), F.col("broadcast_id").alias("event_id"),
        F.lit("online").alias("kind"),
    )
    off = offline.select(
        "streamer_id", "event_time", F.lit(1).alias("_o"), F.lit(0).cast("bigint").alias("event_id"), F.lit("offline").alias("kind")
    )
    order = ["event_time", "_o", "event_id"]
    lv = _levels(on.unionByName(off), order).filter(~F.col("unmatched"))
    nx = shift(lv, ["streamer_id", "level"], order, ["kind", "event_time"], day_bucket("event_time"), "lead")
    closed = nx.filter((F.col("kind") == "online") & (F.col("next_kind") == "offline"))
    return closed.select(F.col("event_id").alias("broadcast_id"), F.col("next_event_time").alias("ended_at"))


def dropped_offline(lifecycle: DataFrame) -> DataFrame:
    """S2 offline events that found no open session, counted per entity."""
    return _levels(lifecycle).filter("unmatched").groupBy("streamer_id").agg(F.count(F.lit(1)).alias("dropped_offline"))


def orphan_sessions(sessions: DataFrame) -> DataFrame:
    """S8 sessions never closed although a later session of the entity started
    (aggregate + join; no per-entity sort)."""
    latest = sessions.groupBy("streamer_id").agg(F.max("started_at").alias("_latest"))
    return sessions.join(latest, "streamer_id").filter(
        F.col("ended_at").isNull() & (F.col("started_at") < F.col("_latest"))
    ).drop("_latest")


def attach_session(events: DataFrame, lifecycle: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each event -> the newest session of its entity open at the event
    time (the top of the entity's stack), or no session.

    The depth at the event comes from the same running sum as sessionization
    (dropped offlines weigh 0); the open session on top is the latest online on
    that level, found by a running count of onlines per (entity, level)."""
    payload = F.struct(*(F.col(c).alias(c) for c in events.columns))
    kind_of = events.select(payload.alias("_e")).schema["_e"].dataType
    lv = _levels(lifecycle).select(
        "streamer_id", "event_time", "event_id", "kind", "level",
        F.when(F.col("unmatched"), 0).when(F.col("kind") == "online", 1).otherwise(-1).alias("_d"),
        F.lit(None).cast(kind_of).alias("_e"),
    )
    ev = events.select(
        "streamer_id", "event_time", "event_id", F.lit("event").alias("kind"), F.lit(None).cast("int").alias("level"),
        F.lit(0).alias("_d"), payload.alias("_e"),
    )
    merged = running_sum(lv.unionByName(ev), ["streamer_id"], ORDER, "_d", day_bucket("event_time"), out="_depth")
    merged = merged.withColumn("_lvl", F.when(F.col("kind") == "event", F.col("_depth")).otherwise(F.col("level")))
    on_lvl = merged.filter(F.col("kind").isin("online", "event")).withColumn("_on", F.when(F.col("kind") == "online", 1).otherwise(0))
    seq = running_sum(on_lvl, ["streamer_id", "_lvl"], ORDER, "_on", day_bucket("event_time"), out="_k")
    # an event at depth 0 finds no session on level 0
    hits = seq.filter(F.col("kind") == "event").select("_e", "streamer_id", F.col("_lvl").alias("level"), F.col("_k").alias("session_seq"))
    keyed = sessions.select("streamer_id", "level", "session_seq", "broadcast_id", F.col("started_at").alias("_started"))
    return hits.join(keyed, ["streamer_id", "level", "session_seq"], "left").select(
        "_e.*", "broadcast_id", F.col("_started").alias("started_at")
    )


def precount(chat: DataFrame, lifecycle: DataFrame, polls: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Messages counted before anything is put in order.  One row for all messages of
    an entity between two neighbouring lifecycle events or poll samples: the time and id
    of its first message, ``n`` and ``last_time``; it attaches and carries over as each
    of its messages would.

    Lifecycle events and samples are few; those of an entity and time bucket meet the
    messages as sorted lists over an equi-join, whose message side may be split, and the
    messages are counted in the tasks.  So no task sorts or holds one channel's messages."""
    width = F.lit(bucket_minutes * 60_000_000)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("event_time"))
    bucket = F.floor(micros / width).cast("bigint").alias("_b")
    place = F.struct("event_time", "event_id")
    cuts = lifecycle.select("streamer_id", bucket, place.alias("_l"), F.lit(None).cast("timestamp_ntz").alias("_p")).unionByName(
        polls.select("streamer_id", bucket, F.lit(None).alias("_l"), F.col("event_time").alias("_p")), allowMissingColumns=True
    )
    cuts = cuts.groupBy("streamer_id", "_b").agg(F.collect_list("_l").alias("_ls"), F.collect_list("_p").alias("_ps"))
    j = chat.withColumn("_b", bucket).join(cuts, ["streamer_id", "_b"], "left")
    # events before a message; a sample at its instant comes first
    after = F.size(F.filter(F.coalesce("_ls", F.array()), lambda c: c < place))
    polled = F.size(F.filter(F.coalesce("_ps", F.array()), lambda c: c <= F.col("event_time")))
    return (
        j.groupBy("streamer_id", "_b", after.alias("_after"), polled.alias("_polled"))
        .agg(F.min(place).alias("_f"), F.count(F.lit(1)).alias("n"), F.max("event_time").alias("last_time"))
        .select("streamer_id", "_f.event_time", "_f.event_id", "n", "last_time")
    )


def validate_tick(minutes: int) -> int:
    """S12 the poll interval must divide an hour (or be whole hours dividing a day)."""
    if minutes <= 0 or (minutes < 60 and 60 % minutes) or (minutes >= 60 and (minutes % 60 or 24 % (minutes // 60))):
        raise ValueError(f"tick of {minutes} minutes does not divide the hour/day")
    return minutes


def chat_delta_carry_over(chat_attached: DataFrame, polls_attached: DataFrame, keep_tail: bool = False) -> DataFrame:
    """S5 (carry-over) + S13: each poll sample of a session gets the messages since
    the previous sample of that session (a missed poll carries its messages to
    the next one).  Messages after the last sample are dropped, or, with
    ``keep_tail``, emitted on a final row with a NULL sample id."""
    weight = F.col("n") if "n" in chat_attached.columns else F.lit(1)  # precounted messages
    c = chat_attached.filter(F.col("broadcast_id").isNotNull()).select(
        "broadcast_id", "event_time", "event_id", F.lit(0).alias("_p"), weight.cast("bigint").alias("_n")
    )
    p = polls_attached.filter(F.col("broadcast_id").isNotNull()).select(
        "broadcast_id", "event_time", "event_id", F.lit(1).alias("_p"), F.lit(0).cast("bigint").alias("_n")
    )
    # a message and a poll at the same instant: the poll reads the counter first
    u = c.unionByName(p).withColumn("_o", F.when(F.col("_p") == 1, 0).otherwise(1))
    r = running_sum(u, ["broadcast_id"], ["event_time", "_o", "event_id"], "_p", day_bucket("event_time"), out="_polls")
    msgs = r.filter(F.col("_p") == 0).groupBy("broadcast_id", (F.col("_polls") + 1).alias("_slot")).agg(
        F.sum("_n").alias("chat_messages_delta")
    )
    polls = r.filter(F.col("_p") == 1).select("broadcast_id", F.col("_polls").alias("_slot"), F.col("event_id").alias("poll_event_id"))
    how = "full_outer" if keep_tail else "left"
    j = polls.join(msgs, ["broadcast_id", "_slot"], how)
    return j.select("broadcast_id", "poll_event_id", F.coalesce("chat_messages_delta", F.lit(0)).alias("chat_messages_delta"))


def snapshot_ticks(polls_attached: DataFrame, chat_attached: DataFrame, minutes: int = 15) -> DataFrame:
    """S6 + S17: one snapshot per live session per tick: the last poll sample of the
    window (viewers, category, followers; a failed follower fetch counts as 0), the
    messages since the session's previous sample (a tick without a sample carries
    its messages to the next one) and the uptime at the window end."""
    w = F.window("event_time", f"{validate_tick(minutes)} minutes")
    p = polls_attached.filter(F.col("broadcast_id").isNotNull() & F.col("viewer_count").isNotNull())
    carried = chat_delta_carry_over(chat_attached, p).select("poll_event_id", "broadcast_id", "chat_messages_delta")
    p = p.join(carried.withColumnRenamed("poll_event_id", "event_id"), ["broadcast_id", "event_id"])
    last = p.groupBy("broadcast_id", "streamer_id", w.alias("w")).agg(
        F.max_by(
            F.struct("viewer_count", "category_id", "follower_count", "started_at"), F.struct("event_time", "event_id")
        ).alias("s"),
        F.sum("chat_messages_delta").alias("_chat"),
    )
    return last.select(
        "broadcast_id",
        "streamer_id",
        F.col("s.category_id").alias("category_id"),
        F.col("w.end").alias("snapshot_timestamp"),
        F.col("s.viewer_count").alias("concurrent_viewers"),
        F.coalesce(F.col("s.follower_count"), F.lit(0)).alias("follower_count"),
        uptime_seconds(F.col("s.started_at"), F.col("w.end")).alias("stream_uptime_seconds"),
        F.col("_chat").cast("int").alias("chat_messages_delta"),
    )


def poll_outcomes(polls: DataFrame, minutes: int = 15) -> DataFrame:
    """S15 successful / failed poll samples per tick (failed = no stream data)."""
    w = F.window("event_time", f"{validate_tick(minutes)} minutes")
    return polls.groupBy(w.alias("w")).agg(
        F.count_if(F.col("viewer_count").isNotNull()).alias("succeeded"),
        F.count_if(F.col("viewer_count").isNull()).alias("failed"),
    ).select(F.col("w.end").alias("tick_end"), "succeeded", "failed")


def filter_chat(chat: DataFrame, tracked: DataFrame) -> DataFrame:
    """S9 drop the bot's own echo and channels that are not tracked
    (case-insensitive), and attach the entity id (J11)."""
    t = tracked.select("streamer_id", F.lower("username").alias("_login"))
    return chat.filter(~F.col("is_echo")).join(t, F.lower(F.col("channel")) == F.col("_login")).drop("_login")
