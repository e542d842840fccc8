"""Aggregations.

Every aggregate here is algebraic or has a partial form (count, sum, avg, min,
max, stddev, max_by, exact percentile as a value->count map, distinct via a
two-level aggregate), so Spark combines map-side before the shuffle: a hot
entity contributes one partial row per map task, never its raw rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import safe_div, zero_if_null
from vantage.operators.filters import completed_sessions, rolling_window
from vantage.sources.tables import ts_lit

# Fixed value: one snapshot stands for a quarter hour.
SNAPSHOT_HOURS = 0.25


def engagement(df_msgs="chat_messages_delta", viewers="concurrent_viewers") -> Column:
    """Chat messages per viewer of one snapshot; NULL when nobody watches."""
    return safe_div(df_msgs, viewers)


def session_metrics(completed: DataFrame, key: str = "streamer_id") -> DataFrame:
    """E1 count, total and mean hours of completed sessions."""
    return completed.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_broadcasts"),
        F.sum("duration_hours").alias("total_broadcast_hours"),
        F.avg("duration_hours").alias("avg_broadcast_duration"),
    )


def snapshot_metrics(snaps: DataFrame, key: str = "streamer_id", follower_mode: str = "range") -> DataFrame:
    """E2-E7 + E9 in one aggregate over the window's snapshots.

    ``follower_mode="range"`` reproduces max - min and max as "latest";
    ``"net"`` uses the value at the last minus the value at the first sample.
    """
    v = F.col("concurrent_viewers")
    f = F.col("follower_count")
    aggs = [
        F.count(F.lit(1)).alias("snapshot_rows"),
        F.avg(v).alias("avg_concurrent_viewers"),
        F.max(v).alias("max_concurrent_viewers"),
        F.median(v).alias("median_concurrent_viewers"),
        F.sum("chat_messages_delta").alias("_msgs"),
        F.sum(v).alias("_viewers"),
        F.count_distinct("category_id").alias("unique_categories"),
    ]
    if follower_mode == "range":
        aggs += [F.max(f).alias("_f_hi"), F.min(f).alias("_f_lo")]
    elif follower_mode == "net":
        ts = F.col("snapshot_timestamp")
        order = F.struct(ts, f)
        aggs += [
            F.max_by(f, order).alias("_f_hi"),
            F.min_by(f, order).alias("_f_lo"),
        ]
    else:
        raise ValueError("follower_mode must be 'range' or 'net'")
    out = snaps.groupBy(key).agg(*aggs)
    return out.select(
        key,
        "snapshot_rows",
        "avg_concurrent_viewers",
        "max_concurrent_viewers",
        "median_concurrent_viewers",
        safe_div("_msgs", F.col("_viewers") * F.lit(SNAPSHOT_HOURS)).alias("avg_chat_rate"),
        "unique_categories",
        (F.col("_f_hi") - F.col("_f_lo")).alias("follower_gain_30d"),
        F.col("_f_hi").alias("latest_follower_count"),
    )


def rolling_statistics(
    streamers: DataFrame,
    broadcasts: DataFrame,
    snapshots: DataFrame,
    as_of,
    window_days: int = 30,
    follower_mode: str = "range",
    only_active: bool = True,
    keep_empty: bool = False,
) -> DataFrame:
    """Q8: per-entity rolling statistics for one calculation date, all entities in
    one job (the reference loops entity by entity).

    Plan: two pruned, filter-pushed scans -> two aggregations keyed by
    ``streamer_id`` -> equi-joins on the same key (the aggregates are already
    hash-partitioned on it, so the joins add no exchange for them) -> COALESCE
    defaults of the reference (J5) -> skip rule (P13).
    """
    sess = completed_sessions(
        rolling_window(broadcasts.select("streamer_id", "started_at", "ended_at"), "started_at", as_of, window_days)
    )
    bm = session_metrics(sess)
    snaps = rolling_window(
        snapshots.select(
            "streamer_id",
            "snapshot_timestamp",
            "concurrent_viewers",
            "chat_messages_delta",
            "category_id",
            "follower_count",
        ),
        "snapshot_timestamp",
        as_of,
        window_days,
    )
    sm = snapshot_metrics(snaps, follower_mode=follower_mode)
    ents = streamers
    if only_active:
        ents = ents.filter(F.col("is_active"))
    ents = ents.select("streamer_id")
    # P13 skip rule: without a completed session nothing is written, so the
    # session aggregate drives the join unless empty rows are requested.
    how = "left" if keep_empty else "inner"
    base = ents.join(bm, "streamer_id", how)
    joined = base.join(sm, "streamer_id", "left")
    gain = zero_if_null("follower_gain_30d")
    hours = zero_if_null("total_broadcast_hours").cast("double")
    velocity = F.when((gain != 0) & (hours > 0), safe_div(gain, hours)).otherwise(F.lit(0.0))
    return joined.select(
        "streamer_id",
        F.lit(str(as_of)[:10]).cast("date").alias("calculation_date"),
        zero_if_null("total_broadcasts").alias("total_broadcasts"),
        hours.alias("total_broadcast_hours"),
        zero_if_null("avg_broadcast_duration").cast("double").alias("avg_broadcast_duration"),
        zero_if_null("avg_concurrent_viewers").cast("double").alias("avg_concurrent_viewers"),
        zero_if_null("max_concurrent_viewers").cast("int").alias("max_concurrent_viewers"),
        zero_if_null("median_concurrent_viewers").cast("double").alias("median_concurrent_viewers"),
        zero_if_null("avg_chat_rate").cast("double").alias("avg_chat_rate"),
        zero_if_null("unique_categories").alias("unique_categories"),
        gain.alias("follower_gain_30d"),
        zero_if_null("latest_follower_count").alias("latest_follower_count"),
        velocity.alias("follower_velocity"),
    )


def stats_history(
    streamers: DataFrame,
    broadcasts: DataFrame,
    snapshots: DataFrame,
    first: str,
    last: str,
    step_days: int,
    window_days: int = 30,
    only_active: bool = True,
) -> DataFrame:
    """V8: the rolling statistics of Q8 for every date of a grid, in one job, from day
    summaries merged over sliding windows (:mod:`vantage.operators.sliding`)."""
    from vantage.operators.sliding import sliding_statistics

    lo = (dt.date.fromisoformat(first) - dt.timedelta(days=window_days)).isoformat()
    hi = (dt.date.fromisoformat(last) + dt.timedelta(days=1)).isoformat()
    inside = lambda df, ts: df.filter((F.col(ts) >= ts_lit(lo)) & (F.col(ts) < ts_lit(hi)))
    sess = completed_sessions(inside(broadcasts.select("streamer_id", "started_at", "ended_at"), "started_at"))
    snaps = snapshots.select(
        "streamer_id", "snapshot_timestamp", "concurrent_viewers", "chat_messages_delta", "category_id", "follower_count"
    )
    ents = streamers.filter(F.col("is_active")) if only_active else streamers
    return sliding_statistics(
        ents, sess, inside(snaps, "snapshot_timestamp"), first, last, step_days, window_days, SNAPSHOT_HOURS
    )


# ------------------------------------------------ E20-E26 extended statistics


def session_rollup(snapshots: DataFrame) -> DataFrame:
    """E20 per session from its snapshots: average viewers (rounded like an
    INTEGER column), peak viewers, total chat messages and follower gain (value
    at the last snapshot minus value at the first, in snapshot order)."""
    from vantage.functions.scalar import round_num
    from vantage.operators.joins import SNAPSHOT_ORDER

    order = F.struct(*SNAPSHOT_ORDER)
    return snapshots.groupBy("broadcast_id").agg(
        round_num(F.avg("concurrent_viewers"), 0).cast("int").alias("average_viewers"),
        F.max("concurrent_viewers").alias("peak_viewers"),
        F.sum("chat_messages_delta").alias("total_chat_messages"),
        (F.max_by("follower_count", order) - F.min_by("follower_count", order)).alias("follower_gain"),
    )


def extended_statistics(broadcasts: DataFrame, snapshots: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """E21-E26 the statistics columns the reference declares but never fills:

    * engagement_consistency: sample stddev across sessions of the per-session
      chat rate (messages / (viewers * 0.25));
    * category_switching_frequency: primary-category changes between consecutive
      sessions, per week of the window;
    * top_category_id / top_category_percentage: category with the most session
      hours and its share of all hours (ties -> smaller id);
    * streaming_consistency: sessions per week;
    * schedule_regularity: 1 / (1 + coefficient of variation of the gaps between
      consecutive session starts);
    * viewer_growth_rate: % change of average viewers against the window of the
      same length just before.
    """
    from vantage.operators.sequence import day_bucket, shift

    weeks = F.lit((window_days + 1) / 7.0)
    sess = completed_sessions(
        rolling_window(broadcasts.select("broadcast_id", "streamer_id", "primary_category_id", "started_at", "ended_at"), "started_at", as_of, window_days)
    )
    snaps = rolling_window(snapshots.select("broadcast_id", "streamer_id", "snapshot_timestamp", "concurrent_viewers", "chat_messages_delta"), "snapshot_timestamp", as_of, window_days)
    per_session = snaps.groupBy("broadcast_id").agg(
        safe_div(F.sum("chat_messages_delta"), F.sum("concurrent_viewers") * F.lit(SNAPSHOT_HOURS)).alias("_rate")
    )
    s = sess.join(per_session, "broadcast_id", "left")
    seq = shift(s, ["streamer_id"], ["started_at", "broadcast_id"], ["primary_category_id", "started_at"], day_bucket("started_at"), "lag")
    gap_h = F.timestamp_diff("MICROSECOND", F.col("prev_started_at"), F.col("started_at")) / F.lit(3.6e9)
    seq = seq.withColumn("_switch", (F.col("primary_category_id") != F.col("prev_primary_category_id")).cast("int")).withColumn("_gap", gap_h)
    ent = seq.groupBy("streamer_id").agg(
        F.stddev_samp("_rate").alias("engagement_consistency"),
        (F.coalesce(F.sum("_switch"), F.lit(0)) / weeks).alias("category_switching_frequency"),
        (F.count(F.lit(1)) / weeks).alias("streaming_consistency"),
        (F.lit(1.0) / (F.lit(1.0) + safe_div(F.stddev_samp("_gap"), F.avg("_gap")))).alias("schedule_regularity"),
        F.sum("duration_hours").alias("_hours"),
    )
    by_cat = sess.filter(F.col("primary_category_id").isNotNull()).groupBy("streamer_id", "primary_category_id").agg(F.sum("duration_hours").alias("_h"))
    top = by_cat.groupBy("streamer_id").agg(
        F.max_by(F.struct("primary_category_id", "_h"), F.struct(F.col("_h"), -F.col("primary_category_id"))).alias("_t")
    )
    prev_as_of = (dt.date.fromisoformat(str(as_of)[:10]) - dt.timedelta(days=window_days + 1)).isoformat()
    cur_v = snaps.groupBy("streamer_id").agg(F.avg("concurrent_viewers").alias("_v"))
    prev_v = rolling_window(snapshots.select("streamer_id", "snapshot_timestamp", "concurrent_viewers"), "snapshot_timestamp", prev_as_of, window_days).groupBy("streamer_id").agg(
        F.avg("concurrent_viewers").alias("_pv")
    )
    out = ent.join(top, "streamer_id", "left").join(cur_v, "streamer_id", "left").join(prev_v, "streamer_id", "left")
    return out.select(
        "streamer_id",
        "engagement_consistency",
        "category_switching_frequency",
        F.col("_t.primary_category_id").alias("top_category_id"),
        (safe_div(F.col("_t._h"), F.col("_hours")) * 100).alias("top_category_percentage"),
        "streaming_consistency",
        "schedule_regularity",
        (safe_div(F.col("_v") - F.col("_pv"), F.col("_pv")) * 100).alias("viewer_growth_rate"),
    )


def candidate_features(broadcasts: DataFrame, snapshots: DataFrame, as_of, window_days: int = 30) -> DataFrame:
    """M18 the reference's suggested extra features over the rolling window:
    variance of streamed hours per day, viewer trend (slope per day), follower
    retention (last count / last count of the first 7 days), top-category share
    of snapshots, and weekend / weekday average viewers."""
    lo = (dt.date.fromisoformat(str(as_of)[:10]) - dt.timedelta(days=window_days))
    sess = completed_sessions(
        rolling_window(broadcasts.select("streamer_id", "started_at", "ended_at"), "started_at", as_of, window_days)
    )
    daily = sess.groupBy("streamer_id", F.to_date("started_at").alias("_d")).agg(F.sum("duration_hours").alias("_h"))
    hv = daily.groupBy("streamer_id").agg(F.var_samp("_h").alias("hours_per_day_variance"))
    snaps = rolling_window(
        snapshots.select("streamer_id", "snapshot_timestamp", "concurrent_viewers", "follower_count", "category_id"), "snapshot_timestamp", as_of, window_days
    )
    day_no = F.timestamp_diff("MICROSECOND", ts_lit(lo), F.col("snapshot_timestamp")) / F.lit(86400e6)
    early = F.col("snapshot_timestamp") < ts_lit(lo + dt.timedelta(days=7))
    order = F.struct("snapshot_timestamp", "follower_count")
    wk = F.dayofweek("snapshot_timestamp").isin(1, 7)
    sm = snaps.groupBy("streamer_id").agg(
        F.regr_slope(F.col("concurrent_viewers").cast("double"), day_no).alias("viewer_trend"),
        F.max_by("follower_count", order).alias("_f_end"),
        F.max_by(F.when(early, F.col("follower_count")), F.when(early, order)).alias("_f_7"),
        F.avg(F.when(wk, F.col("concurrent_viewers"))).alias("_we"),
        F.avg(F.when(~wk, F.col("concurrent_viewers"))).alias("_wd"),
        F.count(F.lit(1)).alias("_n"),
    )
    cat = snaps.filter(F.col("category_id").isNotNull()).groupBy("streamer_id", "category_id").agg(F.count(F.lit(1)).alias("_c"))
    top = cat.groupBy("streamer_id").agg(F.max("_c").alias("_top"))
    j = sm.join(top, "streamer_id", "left").join(hv, "streamer_id", "left")
    return j.select(
        "streamer_id",
        "hours_per_day_variance",
        "viewer_trend",
        safe_div("_f_end", "_f_7").alias("follower_retention"),
        safe_div("_top", "_n").alias("top_category_share"),
        safe_div("_we", "_wd").alias("weekend_weekday_ratio"),
    )
