"""Landing tables and event records (A14-A17) derived from the driver's ``events``.

Event binding: ``signup`` = online, ``error`` = offline, ``click``/``view`` = chat
message, ``purchase`` = poll sample (viewers = floor(value), category = json
``props.k``).  The directory listing of live streams is the poll samples in
arrival order.  The same mapping is restated in SQL by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS = T.TimestampNTZType()

LIFECYCLE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("streamer_id", T.LongType()),
        T.StructField("username", T.StringType()),
        T.StructField("event_time", TS),
        T.StructField("title", T.StringType()),
        T.StructField("category_id", T.LongType()),
    ]
)
CHAT_SCHEMA = T.StructType(
    [
        T.StructField("channel", T.StringType()),
        T.StructField("is_echo", T.BooleanType()),
        T.StructField("event_time", TS),
    ]
)
POLL_SCHEMA = T.StructType(
    [
        T.StructField("streamer_id", T.LongType()),
        T.StructField("viewer_count", T.IntegerType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("follower_count", T.LongType()),
        T.StructField("event_time", TS),
    ]
)

# Fixed values of the binding: login and display name of a user id.
LOGIN_PREFIX = "Customer#"
LOGIN_DIGITS = 9


def display_login(user_id: Column) -> Column:
    """``Customer#000000042``: the entity's display name; its username is the lower case."""
    digits = user_id.cast("string")
    return F.concat(F.lit(LOGIN_PREFIX), F.when(F.length(digits) >= LOGIN_DIGITS, digits).otherwise(F.lpad(digits, LOGIN_DIGITS, "0")))


def _category(props: Column) -> Column:
    return F.get_json_object(props, "$.k").try_cast("bigint")


def lifecycle_events(events: DataFrame) -> DataFrame:
    """A15 online / offline records."""
    kind = F.when(F.col("event_type") == "signup", "online").when(F.col("event_type") == "error", "offline")
    return events.filter(F.col("event_type").isin("signup", "error")).select(
        kind.alias("kind"),
        F.col("user_id").alias("streamer_id"),
        F.lower(display_login(F.col("user_id"))).alias("username"),
        F.col("ts").alias("event_time"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("stream "), F.col("event_id").cast("string"))).alias("title"),
        F.when(F.col("event_type") == "signup", _category(F.col("props"))).alias("category_id"),
        F.col("event_id"),
    )


def chat_events(events: DataFrame) -> DataFrame:
    """A16 chat messages; the channel keeps the display capitalisation so lookups
    must be case-insensitive, and low-value views stand for the bot's own echo."""
    return events.filter(F.col("event_type").isin("click", "view")).select(
        display_login(F.col("user_id")).alias("channel"),
        ((F.col("event_type") == "view") & (F.col("value") < 5)).alias("is_echo"),
        F.col("ts").alias("event_time"),
        F.col("event_id"),
    )


def poll_samples(events: DataFrame) -> DataFrame:
    """A17 poll results: viewers, category, followers (value * 100)."""
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("streamer_id"),
        F.floor("value").cast("int").alias("viewer_count"),
        _category(F.col("props")).alias("category_id"),
        F.floor(F.col("value") * 100).alias("follower_count"),
        F.col("ts").alias("event_time"),
        F.col("event_id"),
    )


def service_events(events: DataFrame) -> DataFrame:
    """Lifecycle, chat (without the bot's echo) and poll records as one table of the live
    service's event rows, in one scan."""
    kind = (
        F.when(F.col("event_type") == "signup", "online")
        .when(F.col("event_type") == "error", "offline")
        .when(F.col("event_type") == "purchase", "poll")
        .when((F.col("event_type") == "click") | ((F.col("event_type") == "view") & ~(F.col("value") < 5)), "chat")
    )
    is_poll, is_online = F.col("event_type") == "purchase", F.col("event_type") == "signup"
    return events.select(
        F.lower(display_login(F.col("user_id"))).alias("login"),
        F.col("user_id").alias("streamer_id"),
        kind.alias("kind"),
        F.col("ts").alias("event_time"),
        F.col("event_id"),
        F.when(is_online, F.concat(F.lit("stream "), F.col("event_id").cast("string"))).alias("title"),
        F.when(is_online | is_poll, _category(F.col("props"))).alias("category_id"),
        F.when(is_poll, F.floor("value").cast("int")).alias("viewer_count"),
        F.when(is_poll, F.floor(F.col("value") * 100)).alias("follower_count"),
    ).where(F.col("kind").isNotNull())


def live_listing(events: DataFrame) -> DataFrame:
    """A14 directory listing of live streams per category (``game_id``) in the
    order the directory returned them (``listing_pos``)."""
    p = poll_samples(events)
    return p.select(
        F.col("category_id").alias("game_id"),
        F.col("streamer_id").alias("user_id"),
        F.lower(display_login(F.col("streamer_id"))).alias("user_login"),
        "viewer_count",
        F.struct("event_time", "event_id").alias("listing_pos"),
    )


def read_listing(spark, path: str, game_id: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A14 landing table reader with an optional category filter (pushed down)."""
    df = spark.read.format(fmt).load(path)
    return df if game_id is None else df.filter(F.col("game_id") == game_id)
