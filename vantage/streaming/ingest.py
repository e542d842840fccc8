"""Stateless and windowed parts of live ingestion (S5-S7, S9-S11, S15, S16); the keyed
session state is in :mod:`vantage.streaming.sessions`.

* ``read_*_stream``: file sources with declared schemas (Kafka by configuration);
* ``tick_counts`` / ``poll_ticks``: event-time tumbling windows with a watermark
  (late data within the watermark still counts, later data is dropped);
* ``dedupe_within_watermark``: replayed samples dropped by key (S7);
* ``filtered_chat``: stream-static join with the tracked entities, re-read every
  micro-batch, so changes to the tracked set are picked up (S9/S10);
* sinks: ``foreachBatch`` writers that are idempotent per batch id, so a
  restarted query that replays a batch overwrites instead of duplicating.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.functions.scalar import instant_to_ntz, ntz_to_instant
from vantage.session import ensure_checkpoint_dir
from vantage.streaming.sessions import EVENT_INSTANT, WATERMARK  # TIMESTAMP twin of the NTZ event time; lateness



def _watermarked(df: DataFrame, watermark: str) -> DataFrame:
    return df.withColumn(EVENT_INSTANT, ntz_to_instant("event_time")).withWatermark(EVENT_INSTANT, watermark)


def _tick(minutes: int):
    return F.window(EVENT_INSTANT, f"{minutes} minutes").alias("w")


def _tick_end():
    return instant_to_ntz(F.col("w.end")).alias("tick_end")

# ------------------------------------------------------------------ sources


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """File stream source with a declared schema (A15-A17).  ``path`` may be a
    directory or a glob; for a glob the parent folder is the base path."""
    r = spark.readStream.schema(schema).format(fmt)
    if any(ch in path for ch in "*?["):
        r = r.option("basePath", os.path.dirname(path))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema) -> DataFrame:
    """The same records from a Kafka topic (JSON values).  Needs the Kafka
    connector on the classpath; absent connectors fail at ``load``."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def event_stream(spark: SparkSession, events_path: str, events_schema) -> DataFrame:
    """The driver's ``events`` table as a stream (one file: read through a glob)."""
    d, base = os.path.split(events_path.rstrip("/"))
    glob = os.path.join(d, base[:-1] + "[" + base[-1] + "]") if "." in base else events_path
    return read_stream(spark, glob, events_schema)


# --------------------------------------------------------- ticks and chat


def filtered_chat(chat_stream: DataFrame, tracked: DataFrame) -> DataFrame:
    """S9 drop echo messages and untracked channels (case-insensitive) and attach
    the entity id: a stream-static join.  The static side keeps the file list it
    was created with; for a tracked set that changes while the query runs use
    ``with_fresh_tracked``."""
    t = tracked.select("streamer_id", F.lower("username").alias("_login"))
    return chat_stream.filter(~F.col("is_echo")).join(t, F.lower(F.col("channel")) == F.col("_login")).drop("_login")


def with_fresh_tracked(tracked_path: str, sink, fmt: str = "parquet"):
    """S10 ``foreachBatch`` step that re-reads the tracked entities at every
    micro-batch (new listing of the table), filters the chat batch with them and
    hands the result to ``sink(df, batch_id)``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        tracked = batch.sparkSession.read.format(fmt).load(tracked_path)
        sink(filtered_chat(batch, tracked), batch_id)

    return step


def tick_counts(chat: DataFrame, minutes: int = 15, watermark: str = WATERMARK) -> DataFrame:
    """S5 (base) chat messages per entity per tick, emitted when the watermark
    passes the tick end (append mode)."""
    return (
        _watermarked(chat, watermark)
        .groupBy(_tick(minutes), "streamer_id")
        .agg(F.count(F.lit(1)).alias("chat_messages_delta"))
        .select("streamer_id", _tick_end(), "chat_messages_delta")
    )


def poll_ticks(polls: DataFrame, minutes: int = 15, watermark: str = WATERMARK) -> DataFrame:
    """S6 the last poll sample of each entity per tick (viewers, category,
    followers; a failed follower fetch counts as 0) and S15 outcome counts."""
    return (
        _watermarked(polls, watermark)
        .groupBy(_tick(minutes), "streamer_id")
        .agg(
            F.max_by(F.struct("viewer_count", "category_id", "follower_count"), F.struct("event_time", "event_id")).alias("s"),
            F.count_if(F.col("viewer_count").isNotNull()).alias("succeeded"),
            F.count_if(F.col("viewer_count").isNull()).alias("failed"),
        )
        .select(
            "streamer_id",
            _tick_end(),
            F.col("s.viewer_count").alias("concurrent_viewers"),
            F.col("s.category_id").alias("category_id"),
            F.coalesce(F.col("s.follower_count"), F.lit(0)).alias("follower_count"),
            "succeeded",
            "failed",
        )
    )


def poll_outcome_ticks(polls: DataFrame, minutes: int = 15, watermark: str = WATERMARK) -> DataFrame:
    """S15 successful / failed polls per tick over all entities."""
    return (
        _watermarked(polls, watermark)
        .groupBy(_tick(minutes))
        .agg(F.count_if(F.col("viewer_count").isNotNull()).alias("succeeded"), F.count_if(F.col("viewer_count").isNull()).alias("failed"))
        .select(_tick_end(), "succeeded", "failed")
    )


def dedupe_within_watermark(df: DataFrame, keys: list[str], ts: str = "event_time", watermark: str = WATERMARK) -> DataFrame:
    """S7 drop replayed rows with a key already seen within the watermark."""
    return df.withColumn(EVENT_INSTANT, ntz_to_instant(ts)).withWatermark(EVENT_INSTANT, watermark).dropDuplicatesWithinWatermark(keys)


# ------------------------------------------------------------------- sinks


def stream_root(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder for one query's
    checkpoint and output."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vantage-streams/{uuid.uuid4().hex}"


def idempotent_parquet_sink(path: str):
    """``foreachBatch`` writer: batch ``n`` goes to ``path/batch_id=n`` with
    overwrite, so a replayed batch replaces its own output (exactly once)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return write


def run_available_now(df: DataFrame, spark: SparkSession, output_mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """S16 one-shot run over everything available, written through the idempotent
    sink; returns the written rows as a batch DataFrame.

    With ``keys`` the query runs in update mode and the newest update of each key is
    returned, which includes windows that the watermark has not closed."""
    root = stream_root(spark)
    out = f"{root}/out"
    q = (
        df.writeStream.outputMode("update" if keys else output_mode)
        .foreachBatch(idempotent_parquet_sink(out))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if not _exists(spark, out):  # there was no batch
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(out)
    if keys:
        others = [c for c in df.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r")).select(*keys, "_r.*")
    return rows.select(*df.columns)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
