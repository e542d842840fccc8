"""Data-quality operators (W7-W9): the CHECK / NOT NULL / UNIQUE / FK rules of
the schema as DataFrame filters.  Parquet enforces none of them, so writers split
rows into ``valid`` and ``quarantine`` (with the failed rule names)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# CHECK rules of the tables (SQL CHECK semantics: NULL passes).
CHECKS = {
    "broadcasts": {
        "check_broadcast_times": "ended_at IS NULL OR ended_at > started_at",
        "check_duration_positive": "duration_seconds IS NULL OR duration_seconds > 0",
        "check_metrics_non_negative": "(average_viewers IS NULL OR average_viewers >= 0) AND "
        "(peak_viewers IS NULL OR peak_viewers >= 0) AND (total_chat_messages IS NULL OR total_chat_messages >= 0)",
    },
    "broadcast_snapshots": {
        "concurrent_viewers_non_negative": "concurrent_viewers >= 0",
        "follower_count_non_negative": "follower_count >= 0",
        "chat_messages_delta_non_negative": "chat_messages_delta >= 0",
    },
    "streamer_statistics": {
        "check_statistics_non_negative": "total_broadcasts >= 0 AND total_broadcast_hours >= 0 AND "
        "unique_categories >= 0 AND avg_concurrent_viewers >= 0 AND follower_gain_30d >= -999999",
    },
}

# NOT NULL columns, unique keys and VARCHAR lengths.
NOT_NULL = {
    "streamers": ["streamer_id", "username"],
    "categories": ["category_id", "category_name"],
    "broadcasts": ["broadcast_id", "streamer_id", "started_at"],
    "broadcast_snapshots": ["broadcast_id", "streamer_id", "snapshot_timestamp", "concurrent_viewers", "follower_count", "chat_messages_delta"],
}
UNIQUE = {
    "streamers": [["streamer_id"]],
    "categories": [["category_id"]],
    "broadcasts": [["broadcast_id"]],
    "broadcast_snapshots": [["broadcast_id", "snapshot_timestamp"]],
    "streamer_statistics": [["streamer_id", "calculation_date"]],
}
MAX_LENGTH = {
    "streamers": {"username": 25, "display_name": 25, "broadcaster_language": 10},
    "categories": {"category_name": 255, "category_type": 50},
}


def validate_checks(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """W7 ``(valid, quarantine)``; quarantine carries ``failed_checks`` (array).  A
    column that the table lacks counts as NULL, so the other terms of its rule are
    still checked; a rule none of whose columns exist is an error."""
    missing = {c for r in rules.values() for c in _columns(r)} - set(df.columns)
    for n, r in rules.items():
        if _columns(r) <= missing:
            raise ValueError(f"rule {n} names no column of the table")
    wide = df.withColumns({c: F.lit(None).cast("double") for c in sorted(missing)})
    fails = [F.when(~F.coalesce(F.expr(r), F.lit(True)), F.lit(n)) for n, r in rules.items()]
    tagged = wide.withColumn("failed_checks", F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")).drop(*missing)
    ok = F.size("failed_checks") == 0
    return tagged.filter(ok).drop("failed_checks"), tagged.filter(~ok)


def _columns(rule: str) -> set[str]:
    """Column names of a rule (keywords are upper case)."""
    return set(re.findall(r"\b[a-z_][a-z_0-9]*\b", rule))


def validate_not_null_length(df: DataFrame, table: str, lengths: dict[str, int] | None = None) -> DataFrame:
    """W8 rows breaking NOT NULL or VARCHAR(n), with the reasons (``lengths``: other
    lengths than the schema's)."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in NOT_NULL.get(table, []) if c in df.columns]
    reasons += [
        F.when(F.length(c) > n, F.lit(f"{c} longer than {n}"))
        for c, n in (lengths or MAX_LENGTH.get(table, {})).items()
        if c in df.columns
    ]
    if not reasons:
        return df.limit(0).withColumn("violations", F.array().cast("array<string>"))
    tagged = df.withColumn("violations", F.array_compact(F.array(*reasons)))
    return tagged.filter(F.size("violations") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """W8 key values that occur more than once, with their count (partial
    aggregation: hot keys are counted map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)


def validate_fk(child: DataFrame, parent: DataFrame, child_col: str, parent_col: str | None = None) -> DataFrame:
    """W9 child rows whose non-NULL reference has no parent (NULL is allowed)."""
    parent_col = parent_col or child_col
    p = parent.select(F.col(parent_col).alias("_pk")).distinct()
    return child.filter(F.col(child_col).isNotNull()).join(p, F.col(child_col) == F.col("_pk"), "left_anti")
