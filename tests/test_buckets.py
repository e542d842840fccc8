"""Entities that share a state key (F8, F9, F11-F15) put out what they would alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vantage.sources import landing as L
from vantage.streaming import ingest as IG
from vantage.streaming import service as SV


@pytest.fixture(scope="module")
def runs(spark):
    """A replay of own rows, one without a login, under one state key and under many."""
    kind = F.element_at(F.array(*map(F.lit, ("signup", "click", "purchase", "view", "click", "error"))), (F.col("id") / 7 % 6 + 1).cast("int"))
    start = dt.datetime(2024, 1, 1)
    events = spark.range(300).select(
        F.col("id").alias("event_id"), (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") * 3)).alias("ts"),
        F.when(F.col("id") % 7 < 6, F.col("id") % 7).alias("user_id"), kind.alias("event_type"), (F.col("id") % 90 + 0.5).alias("value"),
        F.lit('{"k": 3}').alias("props"),
    )
    names = spark.range(7).select(F.col("id").alias("streamer_id"), L.display_login(F.col("id")).alias("username")).where("id < 5")
    found = {}
    for buckets in (1, 64):
        root = IG.stream_root(spark)
        SV.write_tracked(root, names, "2000-01-01 00:00:00")
        late = F.make_dt_interval(mins=(F.col("event_id") * 11 % 40).cast("int"))
        arrivals = L.service_events(events).withColumn("arrived_at", F.col("event_time") + late)
        SV.replay(spark, arrivals, root, slices=2, watermark="2401 seconds", max_session_hours=48, buckets=buckets)
        found[buckets] = root
    return found


def test_records_do_not_depend_on_the_keys(spark, runs):
    one, many = (sorted(map(repr, SV.records(spark, runs[b]).collect())) for b in (1, 64))
    assert one == many and len(one) > 200
    kinds = {r.record for r in SV.records(spark, runs[1]).select("record").distinct().collect()}
    assert kinds >= {"opened", "closed", "message", "sample", "snapshot"}


def test_counters_of_every_entity(spark, runs):
    one, many = (sorted(map(repr, SV.counters(spark, runs[b]).collect())) for b in (1, 64))
    assert one == many and len(one) == len(set(one)) == 7
    state = spark.read.format("statestore").option("path", f"{runs[1]}/{SV.CHECKPOINT}").option("stateVarName", "entity").load()
    assert state.count() == 1  # one key, not one per entity
