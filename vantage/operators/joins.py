"""Joins (J1-J14).

The reference joins entity -> session -> snapshot row by row and aggregates
afterwards.  At scale the snapshot table dominates, so ``session_grain`` first
collapses snapshots per session (partial aggregation happens before the
shuffle), and only then joins sessions (a shuffle of the small side, the
aggregate is already hash-partitioned by ``broadcast_id``).  Every measure of
the row-level join can be rebuilt exactly from the session grain, including the
reference's fan-out of session columns over snapshot rows (T6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import safe_div

# Total order of snapshots inside a session: time first, then every measured
# column, so LAG is deterministic even when a session repeats a timestamp.
SNAPSHOT_ORDER = ("snapshot_timestamp", "category_id", "concurrent_viewers", "chat_messages_delta", "follower_count")

# Rows of one task where nearly every row is a group of its own: what the task sorts and
# counts then stays near 200 MB however large the table is.
ROWS_PER_TASK = 250_000


def task_count(rows: int) -> int:
    """Tasks for ``rows`` rows; 0 (left to Spark) for a table of a few tasks."""
    return -(-rows // ROWS_PER_TASK) if rows > 4 * ROWS_PER_TASK else 0


def spread(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt over ``tasks`` tasks by its keys, so that joins and groups on them stay
    inside a task; as it is for 0 tasks."""
    return df.repartition(tasks, *keys) if tasks else df


def ordered(df: DataFrame, tasks: int, *order) -> DataFrame:
    """``orderBy`` in so many tasks (Spark's own number for 0)."""
    return df.repartitionByRange(tasks, *order).sortWithinPartitions(*order) if tasks else df.orderBy(*order)


def engagement_expr() -> Column:
    return safe_div("chat_messages_delta", "concurrent_viewers")


def session_grain(snapshots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per session (and optional extra keys such as ``category_id``): row count and
    the sufficient statistics of viewers and engagement (n, sum, sum of squares)."""
    e = engagement_expr()
    return snapshots.groupBy("broadcast_id", *by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("concurrent_viewers").alias("sum_viewers"),
        F.count(e).alias("n_eng"),
        F.sum(e).alias("sum_eng"),
        F.sum(e * e).alias("sumsq_eng"),
    )


def star_join(streamers: DataFrame, broadcasts: DataFrame, grain: DataFrame, entity_cols=("username",)) -> DataFrame:
    """J1 entity ⋈ session ⋈ (snapshots at session grain).  Inner joins, so
    sessions without snapshots and entities without sessions drop out."""
    ents = streamers.select("streamer_id", *entity_cols)
    return grain.join(broadcasts, "broadcast_id").join(ents, "streamer_id")


def with_category(df: DataFrame, categories: DataFrame, cols=("category_name", "is_trending")) -> DataFrame:
    """J2 attach the category of the snapshot (not the session's primary one)."""
    return df.join(categories.select("category_id", *cols), "category_id")


def category_star(streamers: DataFrame, broadcasts: DataFrame, categories: DataFrame, grain: DataFrame, cols, tasks: int = 0) -> DataFrame:
    """J1 and J2 for a grain by session and category, nearly as long as the snapshots: the
    entity is joined last, so that groups within an entity need no further exchange."""
    j = grain.join(spread(broadcasts, tasks, "broadcast_id"), "broadcast_id")
    dim = categories.select("category_id", *cols)
    j = spread(j, tasks, "category_id").join(spread(dim, tasks, "category_id"), "category_id")
    ents = streamers.select("streamer_id", "username")
    return spread(j, tasks, "streamer_id").join(spread(ents, tasks, "streamer_id"), "streamer_id")


def role_playing(df: DataFrame, categories: DataFrame, key: str, name_as: str) -> DataFrame:
    """J3 one use of the category dimension under another role (from / to)."""
    dim = categories.select(F.col("category_id").alias(key), F.col("category_name").alias(name_as))
    return df.join(dim, key)


# ---- exact reconstruction of row-level aggregates from the session grain ----


def rows(g="n_rows") -> Column:
    return F.sum(g)


def avg_viewers() -> Column:
    return safe_div(F.sum("sum_viewers"), F.sum("n_rows"))


def avg_engagement() -> Column:
    return safe_div(F.sum("sum_eng"), F.sum("n_eng"))


def stddev_engagement() -> Column:
    """Sample standard deviation from (n, sum, sum of squares); NULL for n < 2."""
    n = F.sum("n_eng").cast("double")
    s = F.sum("sum_eng")
    q = F.sum("sumsq_eng")
    var = (q - s * s / n) / (n - F.lit(1.0))
    return F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))


def fanout_sum(col: str, mode: str = "reference") -> Column:
    """SUM of a session column over the joined snapshot rows.

    ``reference``: the value counts once per snapshot row (T6 fan-out).
    ``session``:   the value counts once per session.
    """
    if mode == "reference":
        return F.sum(F.col(col) * F.col("n_rows"))
    if mode == "session":
        return F.sum(col)
    raise ValueError("mode must be 'reference' or 'session'")


def not_found(requested: DataFrame, found: DataFrame, col: str = "username") -> DataFrame:
    """J10/D2 requested names with no case-insensitive match; duplicates kept."""
    f = found.select(F.lower(F.col(col)).alias("_k")).distinct()
    return requested.join(f, F.lower(requested[col]) == f["_k"], "left_anti")
