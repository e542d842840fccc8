"""Typed tables of the broadcast model and their binding to the driver's tables.

The domain has five tables (entity, category, session, snapshot, daily stats).
Times are ``TIMESTAMP_NTZ`` holding UTC wall time, so results never depend on the
session time zone.  The test corpus ships TPC-H-like tables instead; ``DriverTables``
derives the domain tables from them with plain projections and one join, so every
query's work grows with the input.  The same mapping is written as SQL for the
DuckDB oracle in :mod:`vantage.plans.oracle`.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators.joins import spread, task_count

TS = T.TimestampNTZType()

STREAMERS_SCHEMA = T.StructType(
    [
        T.StructField("streamer_id", T.LongType(), False),
        T.StructField("username", T.StringType(), False),
        T.StructField("display_name", T.StringType()),
        T.StructField("profile_image_url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("broadcaster_language", T.StringType()),
        T.StructField("account_created_at", TS),
        T.StructField("discovered_at", TS),
        T.StructField("last_seen_at", TS),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
    ]
)

CATEGORIES_SCHEMA = T.StructType(
    [
        T.StructField("category_id", T.LongType(), False),
        T.StructField("category_name", T.StringType(), False),
        T.StructField("category_type", T.StringType()),
        T.StructField("box_art_url", T.StringType()),
        T.StructField("igdb_id", T.LongType()),
        T.StructField("is_trending", T.BooleanType()),
        T.StructField("first_seen_at", TS),
        T.StructField("last_seen_at", TS),
    ]
)

BROADCASTS_SCHEMA = T.StructType(
    [
        T.StructField("broadcast_id", T.LongType(), False),
        T.StructField("streamer_id", T.LongType(), False),
        T.StructField("primary_category_id", T.LongType()),
        T.StructField("stream_title", T.StringType()),
        T.StructField("is_mature", T.BooleanType()),
        T.StructField("started_at", TS, False),
        T.StructField("ended_at", TS),
        T.StructField("duration_seconds", T.IntegerType()),
        T.StructField("average_viewers", T.IntegerType()),
        T.StructField("peak_viewers", T.IntegerType()),
        T.StructField("total_chat_messages", T.IntegerType()),
        T.StructField("follower_gain", T.LongType()),
    ]
)

SNAPSHOTS_SCHEMA = T.StructType(
    [
        T.StructField("broadcast_id", T.LongType(), False),
        T.StructField("streamer_id", T.LongType(), False),
        T.StructField("category_id", T.LongType()),
        T.StructField("snapshot_timestamp", TS, False),
        T.StructField("concurrent_viewers", T.IntegerType(), False),
        T.StructField("follower_count", T.LongType(), False),
        T.StructField("chat_messages_delta", T.IntegerType(), False),
        T.StructField("stream_uptime_seconds", T.LongType()),
        T.StructField("viewer_rank", T.IntegerType()),
    ]
)

# Canonical statistics columns, as written by the rolling-statistics job.
STATS_SCHEMA = T.StructType(
    [
        T.StructField("streamer_id", T.LongType(), False),
        T.StructField("calculation_date", T.DateType(), False),
        T.StructField("total_broadcasts", T.LongType()),
        T.StructField("total_broadcast_hours", T.DoubleType()),
        T.StructField("avg_broadcast_duration", T.DoubleType()),
        T.StructField("avg_concurrent_viewers", T.DoubleType()),
        T.StructField("max_concurrent_viewers", T.IntegerType()),
        T.StructField("median_concurrent_viewers", T.DoubleType()),
        T.StructField("avg_chat_rate", T.DoubleType()),
        T.StructField("unique_categories", T.LongType()),
        T.StructField("follower_gain_30d", T.LongType()),
        T.StructField("latest_follower_count", T.LongType()),
        T.StructField("follower_velocity", T.DoubleType()),
    ]
)

SCHEMAS = {
    "streamers": STREAMERS_SCHEMA,
    "categories": CATEGORIES_SCHEMA,
    "broadcasts": BROADCASTS_SCHEMA,
    "broadcast_snapshots": SNAPSHOTS_SCHEMA,
    "streamer_statistics": STATS_SCHEMA,
}

# The statistics table's declared (DDL) column names and the names
# its writer uses for the same measures.  Both spellings must be accepted.
DDL_TO_CANONICAL = {
    "total_streaming_hours": "total_broadcast_hours",
    "unique_categories_streamed": "unique_categories",
    "average_concurrent_viewers": "avg_concurrent_viewers",
    "peak_viewers_30d": "max_concurrent_viewers",
    "median_viewers": "median_concurrent_viewers",
    "average_chat_rate": "avg_chat_rate",
}

# Decimal scale of the stored statistics columns.
STATS_SCALE = {
    "total_broadcast_hours": 2,
    "avg_broadcast_duration": 2,
    "avg_concurrent_viewers": 2,
    "median_concurrent_viewers": 2,
    "avg_chat_rate": 4,
    "follower_velocity": 2,
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Typed Parquet scan of one domain table (A1).

    The declared schema avoids footer-based inference on thousands of files and
    lets Catalyst prune columns and push filters into the scan.
    """
    if name not in SCHEMAS:
        raise ValueError(f"unknown table {name!r}; expected one of {sorted(SCHEMAS)}")
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def ts_lit(value) -> Column:
    """A ``TIMESTAMP_NTZ`` literal from a date/datetime/ISO string (no zone shift)."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat()
    else:
        text = str(value)
    if len(text) == 10:
        text += " 00:00:00"
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


# --------------------------------------------------------------------------
# Binding of the driver's tables to the domain (same mapping as the oracle SQL)
# --------------------------------------------------------------------------

# Fixed values of the binding: discovery dates spread over DISCOVERY_DAYS days
# from DISCOVERY_START; accounts are 365 + (id*13 mod 2000) days older.
DISCOVERY_START = "2001-01-01 00:00:00"
DISCOVERY_DAYS = 240


def bind_streamers(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    discovered = F.expr(
        f"TIMESTAMP_NTZ '{DISCOVERY_START}' + make_dt_interval("
        f"CAST(c_custkey % {DISCOVERY_DAYS} AS INT), CAST((c_custkey * 7) % 24 AS INT), 0, 0)"
    )
    age = F.expr("make_dt_interval(CAST(365 + (c_custkey * 13) % 2000 AS INT), 0, 0, 0)")
    return customer.select(
        key.alias("streamer_id"),
        F.lower("c_name").alias("username"),
        F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("broadcaster_language"),
        (discovered - age).alias("account_created_at"),
        discovered.alias("discovered_at"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def bind_categories(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("category_id"),
        F.col("p_brand").alias("category_name"),
        F.col("p_type").alias("category_type"),
        (F.col("p_size") >= 40).alias("is_trending"),
    )


def _session_hours() -> Column:
    return (F.col("o_orderkey") % 12 + 1).cast("int")


def bind_broadcasts(orders: DataFrame, lineitem: DataFrame | None = None) -> DataFrame:
    """Sessions from orders.  ``primary_category_id`` (smallest part of the order)
    costs an aggregation of lineitem, so it is only derived when asked for."""
    is_open = F.col("o_orderstatus") == "O"
    hours = _session_hours()
    ended = F.when(is_open, F.lit(None).cast(TS)).otherwise(
        F.col("o_orderdate") + F.make_dt_interval(hours=hours)
    )
    sessions = orders.select(
        F.col("o_orderkey").alias("broadcast_id"),
        F.col("o_custkey").alias("streamer_id"),
        F.col("o_orderpriority").alias("stream_title"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_mature"),
        F.col("o_orderdate").alias("started_at"),
        ended.alias("ended_at"),
        F.when(is_open, F.lit(None).cast("int")).otherwise(hours * 3600).alias("duration_seconds"),
        F.floor(F.col("o_totalprice") / 1000).alias("follower_gain"),
    )
    if lineitem is None:
        return sessions
    primary = lineitem.groupBy(F.col("l_orderkey").alias("broadcast_id")).agg(
        F.min("l_partkey").alias("primary_category_id")
    )
    return sessions.join(primary, "broadcast_id", "left")


def bind_snapshots(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Snapshots from order lines; the entity id is denormalized onto each row
    (as the reference schema does) through one equi-join on the order key."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lineitem.join(o, lineitem.l_orderkey == o.o_orderkey)
    return joined.select(
        F.col("l_orderkey").alias("broadcast_id"),
        F.col("o_custkey").alias("streamer_id"),
        F.col("l_partkey").alias("category_id"),
        F.col("l_shipdate").alias("snapshot_timestamp"),
        (F.floor("l_quantity") - 1).cast("int").alias("concurrent_viewers"),
        F.floor("l_extendedprice").alias("follower_count"),
        ((F.col("l_orderkey") * 7 + F.col("l_partkey") * 13) % (F.col("o_custkey") % 300 + 1))
        .cast("int")
        .alias("chat_messages_delta"),
        F.floor(
            F.timestamp_diff("MICROSECOND", F.col("o_orderdate"), F.col("l_shipdate")) / 1e6
        ).alias("stream_uptime_seconds"),
    )


DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass
class DriverTables:
    """Lazy domain views over one driver data folder."""

    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict)
    # In the binding a line may ship before its order date, so a snapshot time
    # does not bound the session start; no snapshot-side time pruning.
    snapshots_follow_start: bool = False

    def raw(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root.rstrip('/')}/{name}.parquet")
        return self._cache[name]

    @property
    def streamers(self) -> DataFrame:
        return bind_streamers(self.raw("customer"))

    @property
    def categories(self) -> DataFrame:
        return bind_categories(self.raw("part"))

    def broadcasts(self, with_primary_category: bool = False) -> DataFrame:
        return bind_broadcasts(
            self.raw("orders"), self.raw("lineitem") if with_primary_category else None
        )

    @property
    def snapshots(self) -> DataFrame:
        return bind_snapshots(self.raw("lineitem"), self.raw("orders"))

    def spread_snapshots(self) -> tuple[DataFrame, int]:
        """The snapshots dealt by session over a number of tasks that grows with them, and
        that number (0: left to Spark)."""
        tasks = task_count(self.raw("lineitem").count())
        return bind_snapshots(spread(self.raw("lineitem"), tasks, "l_orderkey"), spread(self.raw("orders"), tasks, "o_orderkey")), tasks

    @property
    def events(self) -> DataFrame:
        return self.raw("events")


@dataclass
class DomainTables:
    """Domain tables given directly (fixtures, or tables read with ``read_table``)."""

    streamers: DataFrame
    categories: DataFrame
    broadcasts_df: DataFrame
    snapshots: DataFrame
    events: DataFrame | None = None
    # Snapshots are taken while their session is live (snapshot time >= start),
    # so a bound on session starts also bounds snapshot times and prunes the
    # month partitions of the snapshot table.
    snapshots_follow_start: bool = True

    def broadcasts(self, with_primary_category: bool = False) -> DataFrame:
        return self.broadcasts_df

    def spread_snapshots(self) -> tuple[DataFrame, int]:
        """See ``DriverTables.spread_snapshots``."""
        tasks = task_count(self.snapshots.count())
        return spread(self.snapshots, tasks, "broadcast_id"), tasks

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> "DomainTables":
        r = root.rstrip("/")
        return cls(
            read_table(spark, "streamers", f"{r}/streamers"),
            read_table(spark, "categories", f"{r}/categories"),
            read_table(spark, "broadcasts", f"{r}/broadcasts"),
            read_table(spark, "broadcast_snapshots", f"{r}/broadcast_snapshots"),
        )
