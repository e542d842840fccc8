"""V8: rolling statistics of every date of a grid from day summaries.

Every entity's sessions and snapshots are summarised per day first: sums, counts,
extremes, the day's histogram of viewers and its set of categories.  A date's statistics
are merged from the summaries of the days in its window, a RANGE frame over the
entity's days: sums add up, extremes and sets merge, the median is read from the merged
histograms.  So a row is shuffled once, whatever the window's length or the grid's step,
and the frame works on days, of which one entity has no more than the time span holds.

The dates of the grid are placed among the days by the sessions: a session day gives the
grid dates up to the entity's next session day that its own window still covers, so each
date with a session in its window appears once and no other does.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import safe_div, zero_if_null

_EPOCH = dt.date(1970, 1, 1)
_MEASURES = {
    "b_n": "bigint", "b_hours": "double", "n": "bigint", "n_viewers": "bigint", "viewers": "bigint", "messages": "bigint",
    "top": "int", "followers_max": "bigint", "followers_min": "bigint",
    "counts": "array<struct<v:int,n:bigint>>", "categories": "array<bigint>",
}


def _day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def _row(day: Column, is_date: bool, **measures: Column) -> Column:
    """An entry of the day axis: a day's summary, or a date of the grid."""
    found = [measures.get(c, F.lit(None)).cast(t).alias(c) for c, t in _MEASURES.items()]
    return F.struct(day.cast("int").alias("day"), F.lit(is_date).alias("is_date"), *found)


def session_days(sessions: DataFrame, first: str, last: str, step_days: int, window_days: int) -> DataFrame:
    """(streamer_id, entry): a summary per session day and the grid dates after it, from
    completed sessions (started_at, duration_hours)."""
    start, end = ((dt.date.fromisoformat(d) - _EPOCH).days for d in (first, last))
    days = sessions.groupBy("streamer_id", _day("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("b_n"), F.sum("duration_hours").alias("b_hours")
    )
    later = F.lead("day").over(Window.partitionBy("streamer_id").orderBy("day"))
    days = days.withColumn("later", later)
    until = F.least(F.coalesce(F.col("later") - 1, F.lit(end)), F.col("day") + window_days, F.lit(end))
    k_first = F.greatest(F.ceil((F.col("day") - start) / F.lit(float(step_days))), F.lit(0)).cast("int")
    k_last = F.floor((until - start) / F.lit(float(step_days))).cast("int")
    steps = F.when(k_first <= k_last, F.sequence(k_first, k_last)).otherwise(F.array().cast("array<int>"))
    dates = F.transform(steps, lambda k: _row(F.lit(start) + k * step_days, True))
    own = _row(F.col("day"), False, b_n=F.col("b_n"), b_hours=F.col("b_hours"))
    return days.select("streamer_id", F.explode(F.concat(F.array(own), dates)).alias("entry"))


def snapshot_days(snapshots: DataFrame) -> DataFrame:
    """(streamer_id, entry): a summary per day with snapshots.  Equal values of viewers
    and category are counted in the tasks, before the day is put together."""
    v, n = F.col("concurrent_viewers"), F.col("n")
    grain = snapshots.groupBy("streamer_id", _day("snapshot_timestamp").alias("day"), "concurrent_viewers", "category_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("chat_messages_delta").alias("messages"),
        F.max("follower_count").alias("f_max"),
        F.min("follower_count").alias("f_min"),
    )
    days = grain.groupBy("streamer_id", "day").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(v.isNotNull(), n)).alias("n_viewers"),
        F.sum(v * n).alias("viewers"),
        F.sum("messages").alias("messages"),
        F.max(v).alias("top"),
        F.max("f_max").alias("f_max"),
        F.min("f_min").alias("f_min"),
        F.collect_list(F.when(v.isNotNull(), F.struct(v.cast("int").alias("v"), n.alias("n")))).alias("counts"),
        F.collect_set("category_id").alias("categories"),
    )
    entry = _row(
        F.col("day"), False, n=n, n_viewers=F.col("n_viewers"), viewers=F.col("viewers"), messages=F.col("messages"), top=F.col("top"),
        followers_max=F.col("f_max"), followers_min=F.col("f_min"), counts=F.col("counts"), categories=F.col("categories"),
    )
    return days.select("streamer_id", entry.alias("entry"))


def median_of_counts(counts: Column, total: Column) -> Column:
    """The interpolated median of a list of (value, number) pairs that sum to ``total``."""
    low, high = F.floor((total - 1) / F.lit(2.0)), F.ceil((total - 1) / F.lit(2.0))
    empty = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"))

    def add(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(
            seen.alias("seen"),
            F.coalesce(acc["a"], F.when(seen > low, x["v"])).alias("a"),
            F.coalesce(acc["b"], F.when(seen > high, x["v"])).alias("b"),
        )

    return F.aggregate(F.array_sort(counts), empty, add, lambda acc: (acc["a"] + acc["b"]) / F.lit(2.0))


def sliding_statistics(
    entities: DataFrame, sessions: DataFrame, snapshots: DataFrame, first: str, last: str, step_days: int, window_days: int, snapshot_hours: float
) -> DataFrame:
    """Unrounded statistics per entity and grid date with a completed session in
    ``[date - window_days, date + 1)``; the inputs are bounded to the grid already."""
    axis = session_days(sessions, first, last, step_days, window_days).unionByName(snapshot_days(snapshots))
    axis = axis.join(entities.select("streamer_id"), "streamer_id", "left_semi").select("streamer_id", "entry.*")
    w = Window.partitionBy("streamer_id").orderBy("day").rangeBetween(-window_days, 0)
    total = {c: F.sum(c).over(w).alias(c) for c in ("b_n", "b_hours", "n_viewers", "viewers", "messages")}
    merged = axis.select(
        "streamer_id", "day", "is_date", *total.values(),
        F.max("top").over(w).alias("top"), F.max("followers_max").over(w).alias("f_max"), F.min("followers_min").over(w).alias("f_min"),
        F.collect_list("counts").over(w).alias("counts"), F.collect_list("categories").over(w).alias("categories"),
    ).where("is_date")
    gain = zero_if_null(F.col("f_max") - F.col("f_min"))
    hours = zero_if_null("b_hours").cast("double")
    median = median_of_counts(F.flatten("counts"), F.col("n_viewers"))
    return merged.select(
        "streamer_id",
        F.date_from_unix_date("day").alias("calculation_date"),
        F.col("b_n").alias("total_broadcasts"),
        hours.alias("total_broadcast_hours"),
        zero_if_null(F.col("b_hours") / F.col("b_n")).cast("double").alias("avg_broadcast_duration"),
        zero_if_null(safe_div("viewers", "n_viewers")).cast("double").alias("avg_concurrent_viewers"),
        zero_if_null("top").cast("int").alias("max_concurrent_viewers"),
        zero_if_null(median).cast("double").alias("median_concurrent_viewers"),
        zero_if_null(safe_div("messages", F.col("viewers") * F.lit(snapshot_hours))).cast("double").alias("avg_chat_rate"),
        F.size(F.array_distinct(F.flatten("categories"))).cast("long").alias("unique_categories"),
        gain.alias("follower_gain_30d"),
        zero_if_null("f_max").alias("latest_follower_count"),
        F.when((gain != 0) & (hours > 0), safe_div(gain, hours)).otherwise(F.lit(0.0)).alias("follower_velocity"),
    )
