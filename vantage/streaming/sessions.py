"""Keyed state of the live service.

One ``transformWithState`` operator holds, per entity, the stack of open sessions, the
message counter of each and the sample of the tick under way.  Entities share a state key
by hash (``buckets``), since each call to the state store costs far more than a row: a
micro-batch makes some ten calls a bucket, however many entities it holds.  Lifecycle
events, chat messages and poll samples of all entities pass through it in event-time order:

* arrivals wait in a list until the watermark has passed them and an event-time timer
  releases them, sorted by (time, id); so a late online that arrives after a newer
  offline is still opened first, and replayed rows are seen side by side and dropped;
* an online pushes a session, an offline closes the newest (S1, S2); a message or a
  sample belongs to the session on top at its instant (S4);
* a sample reads and resets its session's counter, so a missed poll carries its messages
  over (S5); a message at the sample's very instant counts for the next one; failed
  samples neither read nor reset;
* the last sample of a tick is the tick's snapshot, put out once the watermark has passed
  the tick's end (S6); what a session's last sample left uncounted is put out as its tail
  when it ends (S13);
* ``track`` / ``untrack`` rows switch an entity's messages on and off (S10).  They come
  from a stream of their own, whose folder every micro-batch lists anew, have no lateness
  and count from their time or, where the watermark is further, from the watermark;
* a session that is never closed leaves the state ``max_session`` after its start, with
  its last snapshot and tail; what an entity keeps then is a fixed number of counters
  and one number per stack level it ever reached.

A key holds its entities' arrivals of about one watermark delay and micro-batch (bound it
by ``maxFilesPerTrigger``, and by more buckets for more entities), and rows are read one by
one, never as one frame.
"""

from __future__ import annotations

import contextlib
import json
from collections import defaultdict, namedtuple
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vantage.functions.scalar import instant_to_ntz, ntz_to_instant, uptime_seconds, with_default

WATERMARK = "60 seconds"  # a poll run may be up to a minute late (S11)
MAX_SESSION_HOURS = 7 * 24
DEFAULT_TITLE = "Untitled Stream"
EVENT_INSTANT = "event_instant"
BUCKETS = 4096  # state keys; a checkpoint keeps the number it began with

# The records that pass the state: kind is online, offline, chat, poll or clock (which
# only moves the watermark); login is the lower-cased name of the entity.
EVENT_SCHEMA = (
    "login string, streamer_id bigint, kind string, event_time timestamp_ntz, event_id bigint, title string, "
    "category_id bigint, viewer_count int, follower_count bigint"
)
# Changes of the tracked set.
CHANGE_SCHEMA = "login string, streamer_id bigint, tracked boolean, changed_at timestamp_ntz"

_SESSION = ("started", "level", "seq", "title", "category", "messages", "tick", "viewers", "tick_category", "followers", "tick_messages")
COUNTERS = ("opened", "closed", "expired", "dropped_offline", "messages", "ignored_messages", "samples", "ignored_samples", "failed_samples")
# The state of a bucket.  Rows are kept as JSON, many in one value: each value that goes to
# the state store costs several times what the row itself does.  ``kept`` has an item per
# entity, ``sessions`` one per open session with the place of its entity, and ``started``
# the start of each open session.
_KEPT = ("login", "streamer_id", "tracked", "opened_on", *COUNTERS)
_BUCKET_STATE = "kept string, sessions string, started array<bigint>"
_STARTED, _TICK = _SESSION.index("started"), _SESSION.index("tick")
_WAITING_STATE = "rows string"  # an array of [us, arrival]
_ARRIVAL = ("login", "event_id", "kind", "streamer_id", "title", "category_id", "viewer_count", "follower_count")
Arrival = namedtuple("Arrival", ("us", *_ARRIVAL))
# Rows the operator puts out, by kind of record.
RECORD_SCHEMA = (
    "record string, login string, streamer_id bigint, level bigint, session_seq bigint, started_at timestamp_ntz, "
    "event_time timestamp_ntz, event_id bigint, title string, category_id bigint, viewer_count int, follower_count bigint, messages bigint"
)
_OUTPUT = (
    "record string, login string, streamer_id bigint, level bigint, session_seq bigint, started_us bigint, us bigint, "
    "event_id bigint, title string, category_id bigint, viewer_count int, follower_count bigint, messages bigint"
)


class Entity:
    """Sessions and counters of one entity; ``advance`` takes events in order."""

    def __init__(self, login: str | None, tick: int, longest: int, kept: tuple | None = None, sessions=()) -> None:
        self.login, self.tick, self.longest = login, tick, longest
        self.streamer_id, self.tracked, self.opened_on, counters = None, None, [], [0] * len(COUNTERS)
        if kept is not None:
            _, self.streamer_id, self.tracked, self.opened_on, *counters = kept
        self.open: list[dict] = [dict(zip(_SESSION, x, strict=True)) for x in sessions]
        self.counters = dict(zip(COUNTERS, counters, strict=True))

    def state(self) -> tuple[tuple, list[tuple]]:
        kept = (self.login, self.streamer_id, self.tracked, self.opened_on, *self.counters.values())
        return kept, [tuple(s[k] for k in _SESSION) for s in self.open]

    def _row(self, record: str, s: dict | None, us: int | None, event_id=None, **values) -> Row:
        s = s or {}
        found = {"title": s.get("title"), "category_id": s.get("category"), "viewer_count": None, "follower_count": None, "messages": None} | values
        return Row(
            record=record, login=self.login, streamer_id=self.streamer_id, level=s.get("level"), session_seq=s.get("seq"),
            started_us=s.get("started"), us=us, event_id=event_id, **found,
        )

    def _snapshot(self, s: dict) -> Iterator[Row]:
        if s["tick"] is not None:
            yield self._row(
                "snapshot", s, s["tick"], category_id=s["tick_category"], viewer_count=s["viewers"],
                follower_count=s["followers"], messages=s["tick_messages"],
            )
            s["tick"] = None

    def _end(self, s: dict) -> Iterator[Row]:
        yield from self._snapshot(s)
        if s["messages"]:
            yield self._row("tail", s, None, messages=s["messages"])

    def _expire(self, now: int) -> Iterator[Row]:
        for s in [s for s in self.open if s["started"] + self.longest <= now]:
            self.open.remove(s)
            self.counters["expired"] += 1
            yield self._row("expired", s, s["started"] + self.longest)
            yield from self._end(s)

    def _instant(self, us: int, events: list) -> Iterator[Row]:
        yield from self._expire(us)
        polls, chats, ended, count = [], [], [], self.counters
        for e in events:
            self.streamer_id = e.streamer_id if self.streamer_id is None else self.streamer_id
            top = self.open[-1] if self.open else None
            if e.kind == "online":
                level = top["level"] + 1 if top else 1
                self.opened_on += [0] * (level - len(self.opened_on))
                self.opened_on[level - 1] += 1
                s = dict.fromkeys(_SESSION) | {"started": us, "level": level, "seq": self.opened_on[level - 1], "messages": 0}
                s |= {"title": e.title, "category": e.category_id}
                self.open.append(s)
                count["opened"] += 1
                yield self._row("opened", s, us, e.event_id)
            elif e.kind == "offline" and top:
                ended.append(self.open.pop())
                count["closed"] += 1
                yield self._row("closed", top, us, e.event_id)
            elif e.kind == "offline":
                count["dropped_offline"] += 1
                yield self._row("dropped", None, us, e.event_id)
            elif e.kind in ("track", "untrack"):
                self.tracked = e.kind == "track"
            elif e.kind == "chat" and self.tracked and top:
                chats.append(top)
                count["messages"] += 1
                yield self._row("message", top, us, e.event_id)
            elif e.kind == "chat":
                count["ignored_messages"] += 1
            elif e.kind == "poll" and e.viewer_count is None:
                count["failed_samples"] += 1
            elif e.kind == "poll" and top:
                count["samples"] += 1
                polls.append((top, e))
            elif e.kind == "poll":
                count["ignored_samples"] += 1
        for s, e in polls:  # before the messages of the same instant
            tick = (us // self.tick + 1) * self.tick
            if s["tick"] != tick:
                yield from self._snapshot(s)
                s["tick_messages"] = 0
            read, s["messages"] = s["messages"], 0
            s |= {"tick": tick, "viewers": e.viewer_count, "tick_category": e.category_id, "followers": e.follower_count}
            s["tick_messages"] += read
            yield self._row(
                "sample", s, us, e.event_id, category_id=e.category_id, viewer_count=e.viewer_count,
                follower_count=e.follower_count, messages=read,
            )
        for s in chats:
            s["messages"] += 1
        for s in ended:
            yield from self._end(s)

    def advance(self, events: list, now: int) -> Iterator[Row]:
        """Records of ``events`` (sorted, none after ``now``) and of all ticks and sessions
        that are over by ``now``."""
        for us, same in groupby(events, key=lambda e: e.us):
            once = {(e.event_id, e.kind): e for e in same}  # a replayed row counts once
            yield from self._instant(us, list(once.values()))
        yield from self._expire(now)
        for s in self.open:
            if s["tick"] is not None and s["tick"] <= now:
                yield from self._snapshot(s)


class SessionTracker(StatefulProcessor):
    """The state of one bucket of entities, their waiting arrivals and one timer at a time."""

    CHUNK = 1000

    def __init__(self, minutes: int, max_session_hours: float) -> None:
        self.tick, self.longest = minutes * 60_000_000, int(max_session_hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entity = handle.getValueState("entity", _BUCKET_STATE)
        self.waiting = handle.getListState("waiting", _WAITING_STATE)
        self.timer = handle.getValueState("timer", "at bigint")

    def _load(self) -> dict[str | None, tuple[tuple, list[tuple]]]:
        """What is kept of each entity, and its open sessions, by login."""
        found = self.entity.get()
        if found is None:
            return {}
        states = [(kept, []) for kept in json.loads(found[0])]
        for owner, *session in json.loads(found[1]):
            states[owner][1].append(session)
        return {kept[0]: (kept, sessions) for kept, sessions in states}

    def _save(self, states: dict) -> None:
        kept = [k for k, _ in states.values()]
        sessions = [(owner, *s) for owner, (_, open_now) in enumerate(states.values()) for s in open_now]
        self.entity.update((json.dumps(kept), json.dumps(sessions), [s[_STARTED + 1] for s in sessions]))

    def _due(self, sessions: list[tuple]) -> int | None:
        """The first time at which an entity's sessions put something out by themselves."""
        ticks = [s[_TICK] for s in sessions if s[_TICK] is not None]
        return min(ticks + [s[_STARTED] + self.longest for s in sessions], default=None)

    def _scheduled(self) -> int | None:
        found = self.timer.get()
        return None if found is None else found[0]

    def _schedule(self, before: int | None, us: int | None) -> None:
        """Keep the one timer of the bucket at the earliest millisecond that reaches ``us``."""
        at = None if us is None else -(-us // 1000)
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        self.timer.update((at,))

    def _wait(self, rows: list[tuple[int, str]]) -> None:
        for k in range(0, len(rows), self.CHUNK):
            self.waiting.appendValue(("[" + ",".join(f"[{us},{arrival}]" for us, arrival in rows[k : k + self.CHUNK]) + "]",))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        before = self._scheduled()
        first = None if before is None else before * 1000
        chunk: list[tuple[int, str]] = []
        for _, instant, us, arrival in rows:
            us = max(us, passed) if instant is None else us  # a change of the tracked set
            first = us if first is None else min(first, us)
            chunk.append((us, arrival))
            if len(chunk) == self.CHUNK:
                self._wait(chunk)
                chunk = []
        self._wait(chunk)
        if first is not None and -(-first // 1000) != before:
            self._schedule(before, first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        arrived, rest = defaultdict(list), []
        for us, arrival in (x for (rows,) in self.waiting.get() for x in json.loads(rows)):
            if us <= now:
                arrived[arrival.get("login")].append(Arrival(us, *map(arrival.get, _ARRIVAL)))
            else:
                rest.append((us, json.dumps(arrival)))
        states = self._load()
        due = {login: self._due(sessions) for login, (_, sessions) in states.items()}
        moved = list(arrived) + [login for login, at in due.items() if at is not None and at <= now and login not in arrived]
        for login in moved:
            found = Entity(login, self.tick, self.longest, *states.get(login, ()))
            events = sorted(arrived.get(login, ()), key=lambda e: (e.us, e.event_id is not None, e.event_id))
            yield from found.advance(events, now)
            states[login] = found.state()
            due[login] = self._due(states[login][1])
        if arrived:
            self.waiting.clear()
            self._wait(rest)
        if moved:
            self._save(states)
        self._schedule(None, min([*(us for us, _ in rest), *(at for at in due.values() if at is not None)], default=None))

    def close(self) -> None:
        pass


def _micros(x: str):
    return F.unix_micros(ntz_to_instant(x))


def _from_micros(x: str):
    return instant_to_ntz(F.timestamp_micros(x))


def session_records(
    events: DataFrame,
    changes: DataFrame | None = None,
    minutes: int = 15,
    watermark: str = WATERMARK,
    max_session_hours: float = MAX_SESSION_HOURS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Streaming records of the keyed state from event rows (EVENT_SCHEMA) and changes of
    the tracked set (CHANGE_SCHEMA; without it no message counts)."""
    rows = events.select(
        F.lower("login").alias("login"), "streamer_id", "kind", ntz_to_instant("event_time").alias(EVENT_INSTANT),
        _micros("event_time").alias("us"), "event_id", "title", "category_id", "viewer_count", "follower_count",
    )
    if changes is not None:
        none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("event_id", "title", "category_id", "viewer_count", "follower_count")}
        kind = F.when(F.col("tracked"), "track").otherwise("untrack")
        # no instant: a change is never late
        rows = rows.unionByName(
            changes.select(
                F.lower("login").alias("login"), "streamer_id", kind.alias("kind"), F.lit(None).cast("timestamp").alias(EVENT_INSTANT),
                _micros("changed_at").alias("us"), *(v.alias(c) for c, v in none.items()),
            )
        )
    rows = rows.withWatermark(EVENT_INSTANT, watermark).withColumn("title", with_default("title", DEFAULT_TITLE))
    # names the instant, so that it is not pushed below the watermark: a clock row must pass that
    events_only = (F.col("kind") != "clock") | F.col(EVENT_INSTANT).isNull()
    bucket = F.pmod(F.xxhash64("login"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = rows.where(events_only).select(bucket, EVENT_INSTANT, "us", F.to_json(F.struct(*_ARRIVAL)).alias("arrival"))
    out = keyed.groupBy("bucket").transformWithState(
        SessionTracker(minutes, max_session_hours), _OUTPUT, "append", "eventTime"
    )
    return out.select(
        "record", "login", "streamer_id", "level", "session_seq", _from_micros("started_us").alias("started_at"),
        _from_micros("us").alias("event_time"), "event_id", "title", "category_id", "viewer_count", "follower_count", "messages",
    )


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """State-store settings that ``transformWithState`` needs, for queries started inside."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ------------------------------------------------------------- views of the records


def session_table(records: DataFrame) -> DataFrame:
    """Sessions: each opened one, closed if there is a closing record."""
    keys = ["login", "level", "session_seq"]
    opened = records.where("record = 'opened'").select(
        *keys, "streamer_id", "started_at", F.col("title").alias("stream_title"), F.col("category_id").alias("primary_category_id")
    )
    closed = records.where("record = 'closed'").select(*keys, F.col("event_time").alias("ended_at"))
    seconds = F.timestamp_diff("MICROSECOND", "started_at", "ended_at") / F.lit(1e6)
    out = opened.join(closed, keys, "left").withColumn("duration_seconds", F.round(seconds, 0).cast("int"))
    return out.select("streamer_id", "level", "session_seq", "started_at", "ended_at", "duration_seconds", "stream_title", "primary_category_id")


def attached_messages(records: DataFrame) -> DataFrame:
    """Messages of tracked entities with the session they belong to."""
    return records.where("record = 'message'").select("event_id", "event_time", "streamer_id", "level", "session_seq", "started_at")


def attached_samples(records: DataFrame) -> DataFrame:
    """Poll samples with their session and the messages since its previous sample."""
    return records.where("record = 'sample'").select(
        F.col("event_id").alias("poll_event_id"), "event_time", "streamer_id", "level", "session_seq", "started_at",
        "category_id", "viewer_count", "follower_count", F.col("messages").alias("chat_messages_delta"),
    )


def snapshots(records: DataFrame) -> DataFrame:
    """One snapshot per session and tick."""
    return records.where("record = 'snapshot'").select(
        "streamer_id",
        "level",
        "session_seq",
        "started_at",
        "category_id",
        F.col("event_time").alias("snapshot_timestamp"),
        F.col("viewer_count").alias("concurrent_viewers"),
        F.coalesce("follower_count", F.lit(0)).alias("follower_count"),
        uptime_seconds("started_at", "event_time").alias("stream_uptime_seconds"),
        F.col("messages").cast("int").alias("chat_messages_delta"),
    )


def message_tails(records: DataFrame) -> DataFrame:
    """Messages of each ended session after its last sample."""
    return records.where("record = 'tail'").select(
        "streamer_id", "level", "session_seq", "started_at", F.col("messages").alias("chat_messages_delta")
    )


def state_counters(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counters of every entity, read from the state store of the last finished
    micro-batch; any session can read them while the query runs."""
    read = lambda var: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", var).load()
    # JSON arrays of arrays, whose values all read as strings
    kept = read("entity").select(F.explode(F.from_json("value.kept", "array<array<string>>")).alias("k"))
    kept = kept.select(*(F.col("k")[_KEPT.index(c)].cast("string" if c == "login" else "bigint").alias(c) for c in ("login", *COUNTERS)))
    # an entity all of whose arrivals still wait has counted nothing
    arrivals = read("waiting").select(F.explode(F.from_json("list_element.rows", "array<array<string>>")).alias("a"))
    waiting = arrivals.select(F.get_json_object(F.col("a")[1], "$.login").alias("login"), *(F.lit(0).cast("bigint").alias(c) for c in COUNTERS))
    return kept.unionByName(waiting.distinct()).groupBy("login").agg(*(F.sum(c).alias(c) for c in COUNTERS))
