"""Messages counted before ordering give what single messages give, ties included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from vantage.streaming import lifecycle as LC

T0 = dt.datetime(2024, 1, 1, 10)
LIFE = "kind string, streamer_id long, username string, event_time timestamp_ntz, title string, category_id long, event_id long"


def test_precounted_equals_single_messages(spark):
    rng = random.Random(2)
    life, chat, polls = [], [], []
    for k in range(2500):
        entity = 1 if rng.random() < 0.4 else rng.randrange(2, 6)  # one channel with a third and more
        t = T0 + dt.timedelta(seconds=20 * rng.randrange(600))  # many equal instants
        kind = rng.random()
        if kind < 0.06:
            life.append((rng.choice(["online", "offline"]), entity, "x", t, None, None, k))
        elif kind < 0.15:
            polls.append((entity, None if rng.random() < 0.2 else k, t, k))
        else:
            chat.append((entity, t, k))
    life = spark.createDataFrame(life, LIFE)
    polls = spark.createDataFrame(polls, "streamer_id long, viewer_count int, event_time timestamp_ntz, event_id long")
    chat = spark.createDataFrame(chat, "streamer_id long, event_time timestamp_ntz, event_id long")
    sessions = LC.sessionize_batch(life)
    few = LC.precount(chat, life, polls).cache()
    assert few.agg(F.sum("n")).first()[0] == chat.count() > 3 * few.count()
    single, counted = LC.attach_session(chat, life, sessions).cache(), LC.attach_session(few, life, sessions).cache()
    per = lambda df, n, last: sorted(tuple(r) for r in df.groupBy("broadcast_id").agg(n, F.min("event_time"), F.max(last)).na.fill(0).collect())
    assert per(single, F.count("*"), "event_time") == per(counted, F.sum("n"), "last_time")
    p = LC.attach_session(polls, life, sessions).cache()
    for tail in (False, True):
        a, b = (LC.chat_delta_carry_over(c, p, tail) for c in (single, counted))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_cuts_and_no_messages(spark):
    chat = spark.createDataFrame([(1, T0, 1), (1, T0, 2)], "streamer_id long, event_time timestamp_ntz, event_id long")
    none = spark.createDataFrame([], LIFE)
    polls = spark.createDataFrame([], "streamer_id long, viewer_count int, event_time timestamp_ntz, event_id long")
    assert [(r.event_id, r.n) for r in LC.precount(chat, none, polls).collect()] == [(1, 2)]
    assert LC.precount(chat.limit(0), none, polls).count() == 0
