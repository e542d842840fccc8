"""Window operators (V1-V8).

Windows are always partitioned by a key (session, entity, tick); there is no
global single-partition window.  Ordered passes over a session or an entity go
through the bucketed operators of :mod:`vantage.operators.sequence`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import round_num, safe_div
from vantage.operators.joins import SNAPSHOT_ORDER


def retention_curve(snapshots: DataFrame) -> DataFrame:
    """V1 per snapshot: hours into the session, viewers, engagement and the
    follower change since the previous snapshot of the same session (bucketed
    LAG, so even an endless session is split by day across tasks)."""
    from vantage.operators.sequence import day_bucket, shift

    s = shift(snapshots, ["broadcast_id"], list(SNAPSHOT_ORDER), ["follower_count"], day_bucket("snapshot_timestamp"), "lag")
    return s.select(
        "broadcast_id",
        "snapshot_timestamp",
        round_num(F.col("stream_uptime_seconds") / F.lit(3600.0), 2).alias("hours_into_stream"),
        "concurrent_viewers",
        "chat_messages_delta",
        round_num(safe_div("chat_messages_delta", "concurrent_viewers"), 3).alias("engagement_rate"),
        "follower_count",
        (F.col("follower_count") - F.col("prev_follower_count")).alias("follower_gain_delta"),
    )


def category_switches(snapshots: DataFrame) -> DataFrame:
    """V2 previous category and viewers of the same session (one bucketed LAG pass)."""
    from vantage.operators.sequence import day_bucket, shift

    s = shift(snapshots, ["broadcast_id"], list(SNAPSHOT_ORDER), ["category_id", "concurrent_viewers"], day_bucket("snapshot_timestamp"), "lag")
    return s.select(
        "broadcast_id",
        "snapshot_timestamp",
        "category_id",
        F.col("prev_category_id"),
        "concurrent_viewers",
        F.col("prev_concurrent_viewers").alias("prev_viewers"),
        "chat_messages_delta",
    )


def _first(cols: list[str], order: str):
    """``min_by`` of the packed row; the remaining columns break ties of ``order``."""
    return F.min_by(F.struct(*cols), F.struct(order, *[c for c in cols if c != order])).alias("_r")


def first_record(stats: DataFrame, key: str = "streamer_id", order: str = "calculation_date") -> DataFrame:
    """V3 ``DISTINCT ON (key) ORDER BY key, order`` as one aggregate: ``min_by`` of the
    whole row, combined map-side (no per-key sort, safe for hot keys)."""
    cols = [c for c in stats.columns if c != key]
    return stats.groupBy(key).agg(_first(cols, order)).select(key, "_r.*")


def peak_record(stats: DataFrame, col: str = "avg_concurrent_viewers", key: str = "streamer_id", alias: str = "peak_avg_viewers") -> DataFrame:
    """V4 lifetime maximum per entity."""
    return stats.groupBy(key).agg(F.max(col).alias(alias))


def first_and_peak(
    stats: DataFrame, cols: list[str], col: str = "avg_concurrent_viewers", key: str = "streamer_id", order: str = "calculation_date", alias: str = "peak_avg_viewers"
) -> DataFrame:
    """V3 (``cols`` of the first record) and V4 in one aggregate, so that ``stats`` is
    computed once for both."""
    found = stats.groupBy(key).agg(_first([c for c in cols if c != key], order), F.max(col).alias(alias))
    return found.select(key, "_r.*", alias)


def history(stats: DataFrame, n: int = 30, key: str = "streamer_id", order: str = "calculation_date") -> DataFrame:
    """V7 newest ``n`` rows per entity.  A per-key top-n keeps at most ``n`` rows per
    key in each task's buffer (Spark's WindowGroupLimit), never a whole group."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return stats.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def viewer_rank(snapshots: DataFrame, tick: str = "snapshot_timestamp", bucket_width: int = 64) -> DataFrame:
    """V5 rank of each session among all sessions live at the same tick (1 = most
    viewed, ties share a rank, like ``RANK() OVER (PARTITION BY tick ORDER BY
    viewers DESC)``).

    Computed without sorting a tick as a whole: rows are counted per (tick,
    viewers), a bucketed running count over viewers (descending) gives the
    number of strictly larger values, and the rank joins back."""
    from vantage.operators.sequence import running_sum

    counts = snapshots.groupBy(tick, "concurrent_viewers").agg(F.count(F.lit(1)).alias("_cnt"))
    counts = counts.withColumn("_neg_v", -F.col("concurrent_viewers"))
    cum = running_sum(counts, [tick], ["_neg_v"], "_cnt", F.floor(F.col("_neg_v") / F.lit(bucket_width)), out="_le")
    ranks = cum.select(tick, "concurrent_viewers", (F.col("_le") - F.col("_cnt") + 1).cast("int").alias("viewer_rank"))
    base = snapshots.drop("viewer_rank") if "viewer_rank" in snapshots.columns else snapshots
    return base.join(ranks, [tick, "concurrent_viewers"])


def follower_delta(snapshots: DataFrame) -> DataFrame:
    """V6 follower change between consecutive snapshots of a session and per
    streaming hour (NULL when no time passed), via the bucketed LAG."""
    from vantage.operators.sequence import day_bucket, shift

    s = shift(snapshots, ["broadcast_id"], list(SNAPSHOT_ORDER), ["follower_count", "snapshot_timestamp"], day_bucket("snapshot_timestamp"), "lag")
    hours = F.timestamp_diff("MICROSECOND", F.col("prev_snapshot_timestamp"), F.col("snapshot_timestamp")) / F.lit(3.6e9)
    delta = F.col("follower_count") - F.col("prev_follower_count")
    return s.withColumn("follower_delta", delta).withColumn("follower_delta_per_hour", safe_div(delta, hours)).drop(
        "prev_follower_count", "prev_snapshot_timestamp"
    )
