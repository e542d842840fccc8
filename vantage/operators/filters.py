"""Predicates (P1-P13).  Time bounds are literals so they reach the Parquet scan
as ``PushedFilters`` and prune row groups / monthly partitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import hours_between
from vantage.sources.tables import ts_lit


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d)[:10])


def _as_datetime(d) -> dt.datetime:
    if isinstance(d, dt.datetime):
        return d
    if isinstance(d, dt.date):
        return dt.datetime(d.year, d.month, d.day)
    return dt.datetime.fromisoformat(str(d))


def window_bounds(as_of, days: int = 30) -> tuple[dt.datetime, dt.datetime]:
    """P1 half-open bounds ``[as_of - days, as_of + 1 day)`` (31 calendar days for 30)."""
    d = _as_date(as_of)
    lo = d - dt.timedelta(days=days)
    hi = d + dt.timedelta(days=1)
    return dt.datetime(lo.year, lo.month, lo.day), dt.datetime(hi.year, hi.month, hi.day)


# Month partition column written next to a timestamp (A18 layout).
MONTH_PARTITIONS = {"snapshot_timestamp": "snapshot_month"}


def _month_prune(df: DataFrame, ts: str, lo: dt.datetime | None, hi: dt.datetime | None) -> DataFrame:
    """Restate time bounds on the month partition column when the table has one,
    so the scan skips whole partitions (PartitionFilters), not only row groups."""
    part = MONTH_PARTITIONS.get(ts)
    if part is None or part not in df.columns:
        return df
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(part) >= F.lit(lo.strftime("%Y-%m")))
    if hi is not None:
        cond = cond & (F.col(part) <= F.lit(hi.strftime("%Y-%m")))
    return df.filter(cond)


def rolling_window(df: DataFrame, ts: str, as_of, days: int = 30) -> DataFrame:
    """P1 ``ts >= as_of - days AND ts < as_of + 1 day``."""
    lo, hi = window_bounds(as_of, days)
    return _month_prune(df, ts, lo, hi).filter((F.col(ts) >= ts_lit(lo)) & (F.col(ts) < ts_lit(hi)))


def trailing_days(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    """P2 ``ts > CURRENT_DATE - days`` with the date as a parameter (strict, midnight)."""
    d = _as_date(as_of) - dt.timedelta(days=days)
    return _month_prune(df, ts, dt.datetime(d.year, d.month, d.day), None).filter(F.col(ts) > ts_lit(d))


def trailing_interval(df: DataFrame, ts: str, now, seconds: float) -> DataFrame:
    """P3 ``ts > now - interval`` from an instant."""
    cut = _as_datetime(now) - dt.timedelta(seconds=seconds)
    return _month_prune(df, ts, cut, None).filter(F.col(ts) > ts_lit(cut))


def completed_sessions(broadcasts: DataFrame) -> DataFrame:
    """P4 finished sessions with their length in hours."""
    return broadcasts.filter(F.col("ended_at").isNotNull()).withColumn(
        "duration_hours", hours_between("started_at", "ended_at")
    )


def validate_range(lo: int, hi: int, limit: int | None = None) -> None:
    """P5 argument checks of a discovery run."""
    if lo < 0:
        raise ValueError("min_viewers must be >= 0")
    if hi < lo:
        raise ValueError("max_viewers must be >= min_viewers")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be > 0")


def in_viewer_range(lo: int, hi: int, col: str = "viewer_count"):
    """P5 inclusive range predicate (validated)."""
    validate_range(lo, hi)
    return F.col(col).between(lo, hi)


def hidden_gem_filter(
    stats: DataFrame, max_viewers: float = 500, min_chat_rate: float = 5.0, min_velocity: float = 2.0
) -> DataFrame:
    """P7 low visibility, high engagement, growing."""
    return stats.filter(
        (F.col("avg_concurrent_viewers") < max_viewers)
        & (F.col("avg_chat_rate") > min_chat_rate)
        & (F.col("follower_velocity") > min_velocity)
    )


# P8 named sparse predicates (the reference keeps partial indexes on them).
SPARSE_PREDICATES: dict[str, str] = {
    "live_sessions": "ended_at IS NULL",
    "busy_chat": "chat_messages_delta > 100",
    "trending": "is_trending",
    "has_peak": "peak_viewers IS NOT NULL",
    "positive_chat_rate": "avg_chat_rate > 0",
    "positive_velocity": "follower_velocity > 0",
    "positive_growth": "viewer_growth_rate > 0",
    "positive_consistency": "streaming_consistency > 0",
    "multi_category": "unique_categories > 1",
    "has_language": "broadcaster_language IS NOT NULL",
    "has_type": "category_type IS NOT NULL",
    "has_igdb": "igdb_id IS NOT NULL",
    "active": "is_active",
}


def sparse_filter(df: DataFrame, name: str) -> DataFrame:
    """P8 apply one of the named predicates."""
    return df.filter(F.expr(SPARSE_PREDICATES[name]))


def min_hours(df: DataFrame, hours: float = 10, col: str = "total_broadcast_hours") -> DataFrame:
    """P9 strict ``> hours``."""
    return df.filter(F.col(col) > hours)


def switch_only(df: DataFrame) -> DataFrame:
    """P12 category differs from the previous one; NULL on either side drops."""
    return df.filter(F.col("category_id") != F.col("prev_category_id"))
