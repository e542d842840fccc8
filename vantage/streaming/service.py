"""The live ingestion service: one streaming query over keyed session state, its
tables, and the tracked set it follows.

``start_ingestion`` runs :func:`vantage.streaming.sessions.session_records` and writes
micro-batch ``n`` to ``<root>/records/batch_id=n`` (by kind of record) with overwrite, so
a restart that replays a batch replaces its own output.  Sessions, attached messages
and samples, snapshots and message tails are filters of those records, put out by the
state when the watermark passes them; nothing is recomputed at read time.

The tracked set is a folder of changes, ``<root>/tracked``: every version is appended
as files that the running query's next micro-batch lists (S10).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vantage.operators.writes import bootstrap_entities, maintain_categories
from vantage.streaming import ingest as IG
from vantage.streaming import lifecycle as LC
from vantage.streaming import sessions as S

RECORDS, TRACKED, CHECKPOINT = "records", "tracked", "_checkpoints/records"


def _at(root: str, part: str) -> str:
    return f"{root.rstrip('/')}/{part}"


# ------------------------------------------------------------------ tracked set


def write_tracked(root: str, entities: DataFrame, changed_at, tracked: bool = True) -> None:
    """Append a version of the tracked set: ``entities`` (streamer_id, username) are
    followed, or no longer followed, from ``changed_at`` on."""
    entities.select(
        F.lower("username").alias("login"),
        F.col("streamer_id").cast("bigint").alias("streamer_id"),
        F.lit(tracked).alias("tracked"),
        F.lit(changed_at).cast("timestamp_ntz").alias("changed_at"),
    ).write.mode("append").parquet(_at(root, TRACKED))


def tracked_now(spark: SparkSession, root: str) -> DataFrame:
    """The newest state of every entity in the tracked set (login, streamer_id)."""
    changes = spark.read.schema(S.CHANGE_SCHEMA).parquet(_at(root, TRACKED))
    newest = changes.groupBy("login").agg(F.max_by(F.struct("streamer_id", "tracked"), F.struct("changed_at", "tracked")).alias("n"))
    return newest.where("n.tracked").select("login", "n.streamer_id")


def bootstrap(spark: SparkSession, root: str, streamers: DataFrame, names: DataFrame, profiles: DataFrame, now) -> DataFrame:
    """W15 at service start: the entity table (with the configured names if none was
    active), whose active entities become the first version of the tracked set unless
    one exists already."""
    entities = bootstrap_entities(streamers, names, profiles, now)
    if not IG._exists(spark, _at(root, TRACKED)):
        write_tracked(root, entities.where("is_active"), now)
    return entities


# ---------------------------------------------------------------------- the query


def _write_records(root: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("record").parquet(f"{_at(root, RECORDS)}/batch_id={batch_id}")

    return write


def start_ingestion(
    spark: SparkSession,
    events: DataFrame,
    root: str,
    minutes: int = 15,
    watermark: str = S.WATERMARK,
    max_session_hours: float = S.MAX_SESSION_HOURS,
    buckets: int = S.BUCKETS,
    available_now: bool = False,
    processing_time: str = "1 minute",
) -> StreamingQuery:
    """Start (or go on with) the service over a stream of ``sessions.EVENT_SCHEMA`` rows."""
    LC.validate_tick(minutes)
    if not IG._exists(spark, _at(root, TRACKED)):  # an empty version, so that the folder can be followed
        write_tracked(root, spark.createDataFrame([], "streamer_id bigint, username string"), "1970-01-01")
    changes = IG.read_stream(spark, _at(root, TRACKED), S.CHANGE_SCHEMA)
    records = S.session_records(events, changes, minutes, watermark, max_session_hours, buckets)
    writer = (
        records.writeStream.outputMode("append")
        .foreachBatch(_write_records(root))
        .option("checkpointLocation", _at(root, CHECKPOINT))
        .queryName("vantage_sessions")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    with S.keyed_state(spark):
        return writer.start()


def collect(spark: SparkSession, events: DataFrame, root: str, **options) -> None:
    """Take in everything that is there now and stop; the next call goes on from
    the checkpoint."""
    query = start_ingestion(spark, events, root, available_now=True, **options)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def replay(
    spark: SparkSession, arrivals: DataFrame, root: str, slices: int, before: Callable[[int], None] | None = None, **options
) -> None:
    """Take in a stored table of event rows with ``arrived_at`` as the service would have
    met it: ``slices`` equal spans of arrival time land one after another, each is
    collected by a run of its own that resumes the last one's state, and a clock row
    at the end lets the watermark pass everything, sessions that never close included.
    ``before`` is called with the number of each slice before it lands."""
    ends = arrivals.agg(F.min("arrived_at").alias("a"), F.max("arrived_at").alias("b"), F.max("event_time").alias("t")).first()
    landing = _at(root, "landing")
    columns = [f.name for f in T._parse_datatype_string(S.EVENT_SCHEMA).fields]

    def land(rows: DataFrame) -> None:
        rows.select(*columns).write.mode("append").parquet(landing)
        collect(spark, IG.read_stream(spark, landing, S.EVENT_SCHEMA), root, **options)

    if ends["t"] is None:
        return
    step = (ends["b"] - ends["a"]) / slices
    for k in range(slices):
        since, until = F.lit(ends["a"] + k * step), F.lit(ends["a"] + (k + 1) * step)
        last = k == slices - 1
        if before:
            before(k)
        inside = F.col("arrived_at") >= since
        land(arrivals.where(inside if last else inside & (F.col("arrived_at") < until)))
    after = ends["t"] + dt.timedelta(days=1, hours=2 * options.get("max_session_hours", S.MAX_SESSION_HOURS))
    land(spark.createDataFrame([(None, None, "clock", after, None, None, None, None, None)], S.EVENT_SCHEMA))


# ------------------------------------------------------------------------- tables


def records(spark: SparkSession, root: str) -> DataFrame:
    """All records that the query has put out."""
    at = _at(root, RECORDS)
    schema = T._parse_datatype_string(S.RECORD_SCHEMA)
    if not IG._exists(spark, at):
        return spark.createDataFrame([], schema)
    parts = [T.StructField("batch_id", T.LongType())]
    return spark.read.schema(T.StructType([*schema.fields, *parts])).parquet(at).select(*schema.names)


def sessions_table(spark: SparkSession, root: str) -> DataFrame:
    return S.session_table(records(spark, root))


def snapshots_table(spark: SparkSession, root: str) -> DataFrame:
    return S.snapshots(records(spark, root))


def categories_table(spark: SparkSession, root: str, categories: DataFrame) -> DataFrame:
    """``categories`` with those met in snapshots, and when they were seen."""
    return maintain_categories(categories, snapshots_table(spark, root).select("category_id", "snapshot_timestamp"))


def counters(spark: SparkSession, root: str) -> DataFrame:
    """The counters of every entity as of the last finished micro-batch."""
    return S.state_counters(spark, _at(root, CHECKPOINT))
