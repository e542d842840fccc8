"""End-to-end jobs on stored domain tables (sample rows written to Parquet)."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from vantage.operators.model import load_model
from vantage.plans import jobs
from vantage.sources.fixture import load_fixture
from vantage.sources.tables import DomainTables


def _store(spark):
    d = tempfile.mkdtemp(prefix="vantage-test-")
    t = load_fixture(spark)
    for name, df in (("streamers", t.streamers), ("categories", t.categories), ("broadcasts", t.broadcasts()), ("broadcast_snapshots", t.snapshots)):
        df.write.parquet(os.path.join(d, name))
    return d, DomainTables.read(spark, d)


def test_daily_statistics_and_backfill(spark):
    d, t = _store(spark)
    path = os.path.join(d, "stats")
    dry = jobs.daily_statistics(t, path, "2025-10-29", dry_run=True)
    assert dry["would_write"] == 4 and dry["skipped"] == 1 and not os.path.exists(path)
    s1 = jobs.daily_statistics(t, path, "2025-10-29")
    s2 = jobs.daily_statistics(t, path, "2025-10-29")  # rerun replaces the date
    assert s1 == s2 and s1["written"] == 4 and s1["failed"] == 0
    assert spark.read.parquet(path).count() == 4
    b = jobs.backfill(t, path, "2025-10-25", "2025-10-30")
    assert b["dates"] == 5
    stored = spark.read.parquet(path)
    assert stored.select("calculation_date").distinct().count() == 5
    day = stored.filter("calculation_date = '2025-10-29'").orderBy("streamer_id").select("streamer_id", "total_broadcasts").collect()
    assert [tuple(r) for r in day] == [(1001, 3), (1002, 2), (1003, 2), (1004, 1)]


def test_train_and_score_jobs(spark):
    d = tempfile.mkdtemp(prefix="vantage-test-")
    rows = []
    for i in range(120):
        pos = i % 4 == 0
        for k, day in enumerate(("2025-01-01", "2025-02-01")):
            avg = (20000.0 if (pos and k == 1) else 100.0 + (i % 7)) if not pos else (500.0 + i if k == 0 else 20000.0)
            rows.append((i, dt.date.fromisoformat(day), 5, 20.0, 4.0, avg, 10, 50.0, 1.0 + (i % 3), 1, 10 + i, 1000 + i, 1.0))
    from vantage.sources.tables import STATS_SCHEMA

    spark.createDataFrame(rows, STATS_SCHEMA).write.parquet(os.path.join(d, "stats"))
    out = jobs.train_job(spark, os.path.join(d, "stats"), os.path.join(d, "model"), os.path.join(d, "report"), maxIter=5, maxDepth=3)
    assert out["roc_auc"] > 0.9 and out["class_weight"] == 3.0
    assert spark.read.json(os.path.join(d, "report", "report")).count() == 5
    model = load_model(os.path.join(d, "model"))
    feats = spark.read.parquet(os.path.join(d, "stats")).filter("calculation_date = '2025-01-01'").select(
        F.concat(F.lit("user"), F.col("streamer_id")).alias("username"),
        "total_broadcasts", "total_broadcast_hours",
        F.col("avg_concurrent_viewers").alias("first_30d_avg_viewers"), F.col("avg_chat_rate").alias("first_30d_chat_rate"),
        F.col("follower_gain_30d").alias("first_30d_follower_gain"), F.col("follower_velocity").alias("first_30d_follower_velocity"),
        F.col("unique_categories").alias("first_30d_unique_categories"), F.col("latest_follower_count").alias("first_30d_follower_count"),
    )
    csv = os.path.join(d, "in.csv")
    feats.coalesce(1).write.option("header", True).csv(csv)
    path, top = jobs.score_job(spark, model, csv)
    assert path.endswith("in_predictions.csv")
    assert top.count() == 10 and spark.read.option("header", True).csv(path).count() == 120


def test_discovery_job(spark):
    t = load_fixture(spark)
    listing = spark.createDataFrame(
        [(7, 1001, 150, 1), (7, 2001, 50, 2), (7, 2002, 150, 3), (7, 2003, 200, 4), (7, 2004, 180, 5), (8, 2005, 120, 6)],
        "game_id long, user_id long, viewer_count int, pos long",
    ).withColumn("listing_pos", F.struct("pos")).drop("pos")
    profiles = spark.createDataFrame(
        [(2002, "u2002", "U2002"), (2003, "u2003", "U2003"), (2004, "u2004", "U2004"), (2005, "u2005", "U2005")],
        "streamer_id long, username string, display_name string",
    )
    new, summary = jobs.discovery_job(t, listing, profiles, 100, 300, 2, "2025-11-01 00:00:00")
    assert sorted(r.streamer_id for r in new.collect()) == [2002, 2003, 2005]
    s = {r.game_id: (r.processed, r.skipped, r.added) for r in summary.collect()}
    # game 7: 1001 tracked (skip), 2001 out of range, 2002 and 2003 added -> stop after the 4th row
    assert s[7] == (4, 1, 2) and s[8] == (1, 0, 1)
    dry, _ = jobs.discovery_job(t, listing, profiles, 100, 300, 2, "2025-11-01 00:00:00", dry_run=True)
    assert sorted(r.streamer_id for r in dry.collect()) == [2002, 2003, 2005]  # 1001 has no profile here
