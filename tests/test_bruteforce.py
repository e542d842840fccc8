"""Stack semantics against a brute-force Python simulation on a skewed stream:
one entity holds about a third of all events, spread over many days."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vantage.streaming import lifecycle as LC


def _events(seed=11, n=900):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        sid = 0 if rnd.random() < 0.34 else rnd.randrange(1, 12)
        t = t0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        kind = "online" if rnd.random() < 0.55 else "offline"
        rows.append((kind, sid, "u", t, None, None, i))
    return rows


def _simulate(rows):
    """Reference semantics, one event at a time: online pushes, offline pops."""
    stacks, sessions, dropped = {}, [], {}
    for kind, sid, _, t, _, _, eid in sorted(rows, key=lambda r: (r[3], r[6])):
        st = stacks.setdefault(sid, [])
        if kind == "online":
            rec = {"streamer_id": sid, "started_at": t, "ended_at": None}
            st.append(rec)
            sessions.append(rec)
        elif st:
            st.pop()["ended_at"] = t
        else:
            dropped[sid] = dropped.get(sid, 0) + 1
    return sessions, dropped, stacks


SCHEMA = "kind string, streamer_id long, username string, event_time timestamp_ntz, title string, category_id long, event_id long"


def test_sessionize_matches_simulation(spark):
    rows = _events()
    sessions, dropped, _ = _simulate(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.streamer_id, r.started_at, r.ended_at) for r in LC.sessionize_batch(df).collect())
    want = sorted((s["streamer_id"], s["started_at"], s["ended_at"]) for s in sessions)
    assert got == want
    got_d = {r.streamer_id: r.dropped_offline for r in LC.dropped_offline(df).collect()}
    assert got_d == dropped


def test_attach_matches_simulation(spark):
    rows = _events(seed=5)
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    probes = [(rnd.choice([0, 0, 1, 2, 3]), t0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20), seconds=30), 10_000 + i) for i in range(300)]
    # brute force: top of the stack at each probe time
    want = {}
    for sid, t, eid in probes:
        _, _, stacks = _simulate([r for r in rows if r[3] < t])
        st = stacks.get(sid, [])
        want[eid] = st[-1]["started_at"] if st else None
    life = spark.createDataFrame(rows, SCHEMA)
    ev = spark.createDataFrame(probes, "streamer_id long, event_time timestamp_ntz, event_id long")
    sess = LC.sessionize_batch(life)
    got = {r.event_id: r.started_at for r in LC.attach_session(ev, life, sess).collect()}
    assert got == want


def test_hot_entity_is_split_by_bucket(spark):
    df = spark.createDataFrame(_events(), SCHEMA)
    plan = LC.sessionize_batch(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(streamer_id" in plan and "_b" in plan
