"""Entity and session lookups (A2-A8), set operations (D2-D4) and the
statistics column renames (P6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.sources.tables import DDL_TO_CANONICAL


def active_entities(streamers: DataFrame) -> DataFrame:
    """A2 active entities by id."""
    return streamers.filter(F.col("is_active")).select("streamer_id", "username", "display_name").orderBy("streamer_id")


def tracked_entities(streamers: DataFrame) -> DataFrame:
    """A3 the tracked list (active entities) by username."""
    return streamers.filter(F.col("is_active")).select("streamer_id", "username").orderBy("username", "streamer_id")


def entity_by_id(streamers: DataFrame, streamer_id: int) -> DataFrame:
    """A4 point lookup (pushed equality filter)."""
    return streamers.filter(F.col("streamer_id") == F.lit(streamer_id))


def entity_by_username(streamers: DataFrame, username: str) -> DataFrame:
    """A5 case-insensitive lookup."""
    return streamers.filter(F.lower("username") == F.lower(F.lit(username))).select("streamer_id", "username", "display_name")


def open_sessions(broadcasts: DataFrame) -> DataFrame:
    """A6 live sessions, newest first."""
    return broadcasts.filter(F.col("ended_at").isNull()).orderBy(F.col("started_at").desc(), "broadcast_id")


def latest_open_session(broadcasts: DataFrame) -> DataFrame:
    """A7 newest open session per entity, for all entities at once (``max_by``
    aggregate: combined map-side, no per-entity sort)."""
    o = broadcasts.filter(F.col("ended_at").isNull())
    return o.groupBy("streamer_id").agg(
        F.max_by(F.struct("broadcast_id", "started_at"), F.struct("started_at", "broadcast_id")).alias("s")
    ).select("streamer_id", "s.broadcast_id", "s.started_at")


def snapshot_count(snapshots: DataFrame) -> DataFrame:
    """A8 snapshots per session."""
    return snapshots.groupBy("broadcast_id").agg(F.count(F.lit(1)).alias("snapshot_count"))


def table_counts(streamers: DataFrame, broadcasts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """E37 row counts, active entities and live sessions."""
    e = streamers.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_active")).alias("k")).select(
        F.lit("streamers").alias("table_name"), F.col("n").alias("row_count"), F.col("k").alias("active_or_live")
    )
    b = broadcasts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ended_at").isNull()).alias("k")).select(
        F.lit("broadcasts").alias("table_name"), F.col("n").alias("row_count"), F.col("k").alias("active_or_live")
    )
    s = snapshots.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("broadcast_snapshots").alias("table_name"), F.col("n").alias("row_count"), F.lit(None).cast("long").alias("active_or_live")
    )
    return e.unionByName(b).unionByName(s)


def tracked_union(tracked: DataFrame, added: DataFrame, col: str = "username") -> DataFrame:
    """D3 tracked set plus new names (case-insensitive, no duplicates)."""
    return tracked.select(F.lower(col).alias(col)).unionByName(added.select(F.lower(col).alias(col))).distinct()


def tracked_difference(tracked: DataFrame, removed: DataFrame, col: str = "username") -> DataFrame:
    """D4 tracked set without the removed names."""
    r = removed.select(F.lower(col).alias("_k")).distinct()
    return tracked.join(r, F.lower(tracked[col]) == r["_k"], "left_anti")


def rename_stats(stats: DataFrame, to: str = "canonical") -> DataFrame:
    """P6 statistics columns between the declared (DDL) names and the writer's
    names; ``to="canonical"`` accepts either spelling on input."""
    mapping = DDL_TO_CANONICAL if to == "canonical" else {v: k for k, v in DDL_TO_CANONICAL.items()}
    return stats.withColumnsRenamed({k: v for k, v in mapping.items() if k in stats.columns})
