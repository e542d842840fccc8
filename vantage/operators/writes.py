"""Merges, deletes and maintenance (W1-W6, W10-W18, A19) as DataFrame algebra.

Parquet has no MERGE, so each write operator returns the *new state* of the
table (or the rows to append) and a sink writes it; ``dry_run`` is simply not
calling the sink (W12).  Duplicate keys are resolved with ``min_by``/``max_by``
aggregates, which combine map-side, so a key that repeats a billion times never
lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import safe_div, seconds_between, with_default
from vantage.sources.tables import ts_lit


def first_per_key(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the smallest by ``order`` (then by every other column, so
    the choice is deterministic).  Aggregate-based, skew-safe."""
    others = [c for c in df.columns if c not in keys]
    order = order or others
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in others if c not in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_r")).select(*keys, "_r.*")


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None):
    """W1 ``INSERT ... ON CONFLICT DO NOTHING``.

    Returns ``(inserted, skipped)``: the first incoming row per key that is not in
    the target, and every other incoming row (conflicts with the target and
    repeats inside the batch).  ``inserted ∪ skipped`` is the input multiset."""
    chosen = first_per_key(incoming, keys, order).select(*incoming.columns)
    t = target.select(*keys)
    inserted = chosen.join(t, keys, "left_anti").select(*incoming.columns)
    skipped = incoming.exceptAll(inserted)
    return inserted, skipped


def upsert_entities(target: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """W2 ``ON CONFLICT (streamer_id) DO UPDATE SET username, display_name
    (defaulting to username), updated_at``; every other column keeps its value.
    New ids are inserted with defaults (W6)."""
    inc = first_per_key(incoming.select("streamer_id", "username", "display_name"), ["streamer_id"]).select(
        "streamer_id",
        F.col("username").alias("_u"),
        with_default("display_name", "").alias("_d0"),
    ).withColumn("_d", F.coalesce(F.nullif("_d0", F.lit("")), F.col("_u"))).drop("_d0")
    j = target.join(inc, "streamer_id", "full_outer")
    matched = F.col("_u").isNotNull()
    cols = []
    for c in target.columns:
        if c == "username":
            cols.append(F.when(matched, F.col("_u")).otherwise(F.col(c)).alias(c))
        elif c == "display_name":
            cols.append(F.when(matched, F.col("_d")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(matched, ts_lit(now)).otherwise(F.col(c)).alias(c))
        elif c in ("created_at", "discovered_at"):
            cols.append(F.coalesce(F.col(c), ts_lit(now)).alias(c))
        elif c == "is_active":
            cols.append(F.coalesce(F.col(c), F.lit(True)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


STATS_KEYS = ["streamer_id", "calculation_date"]


def upsert_stats(target: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """W3 idempotent statistics upsert on (streamer_id, calculation_date).

    Measures come from the incoming row; ``updated_at`` becomes ``now``;
    ``created_at`` and ``calculated_at`` keep the stored values on conflict and are
    stamped on inserted rows only; rows that are not hit stay as they are.
    Applying the same incoming twice gives the same table."""
    measures = [c for c in incoming.columns if c not in STATS_KEYS]
    tgt = target
    for c in ("created_at", "calculated_at", "updated_at"):
        if c not in tgt.columns:
            tgt = tgt.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    inc = incoming.select(*STATS_KEYS, *[F.col(c).alias(f"_n_{c}") for c in measures]).withColumn("_hit", F.lit(True))
    j = tgt.withColumn("_old", F.lit(True)).join(inc, STATS_KEYS, "full_outer")
    hit, new = F.col("_hit").isNotNull(), F.col("_old").isNull()
    stamp = ts_lit(now)
    out = [F.col(k) for k in STATS_KEYS]
    for c in [c for c in tgt.columns if c not in STATS_KEYS]:
        if c in measures:
            out.append(F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, stamp).otherwise(F.col(c)).alias(c))
        elif c in ("created_at", "calculated_at"):
            out.append(F.when(new, stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def session_key(streamer_id: Column, started_at: Column, *place: Column) -> Column:
    """W4 stable session id: the same (entity, start, place) always hashes to the same
    id, so replays after a failure create no second row.  ``place`` tells sessions
    that one entity opens at the same instant apart (the event id, or level and
    sequence); the natural key stays in the row."""
    return F.abs(F.xxhash64(streamer_id, started_at, *place))


def create_sessions(online: DataFrame) -> DataFrame:
    """W4 one session row per online event (title/category defaults as S1)."""
    return online.select(
        session_key(F.col("streamer_id"), F.col("event_time"), F.col("event_id")).alias("broadcast_id"),
        "streamer_id",
        F.col("category_id").alias("primary_category_id"),
        with_default("title", "Untitled Stream").alias("stream_title"),
        F.col("event_time").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        F.lit(None).cast("int").alias("duration_seconds"),
    )


def close_sessions(broadcasts: DataFrame, offline: DataFrame, now=None) -> DataFrame:
    """W5 each offline event closes the newest session of its entity that is still
    open at that moment (``ended_at``, ``duration_seconds`` in rounded epoch seconds);
    an offline that finds none open is dropped.

    The stored open sessions are pushed as online events and matched by the stack
    rule of the lifecycle, in bucketed ordered passes."""
    from vantage.streaming.lifecycle import match_offlines

    open_ = broadcasts.filter(F.col("ended_at").isNull()).select("broadcast_id", "streamer_id", "started_at")
    hits = match_offlines(open_, offline).withColumnsRenamed({"broadcast_id": "_bid", "ended_at": "_end"})
    j = broadcasts.join(hits, broadcasts.broadcast_id == hits._bid, "left")
    closed = F.col("_end").isNotNull()
    out = []
    for c in broadcasts.columns:
        if c == "ended_at":
            out.append(F.when(closed, F.col("_end")).otherwise(F.col(c)).alias(c))
        elif c == "duration_seconds":
            out.append(
                F.when(closed, F.round(seconds_between("started_at", "_end"), 0).cast("int")).otherwise(F.col(c)).alias(c)
            )
        elif c == "updated_at" and now is not None:
            out.append(F.when(closed, ts_lit(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def apply_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """W6 ``COALESCE(col, default)`` for the given columns."""
    return df.select(*[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in df.columns])


def delete_cascade(parent_ids: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """W10 remove every child row that references a deleted parent id."""
    ids = parent_ids.select(key).distinct()
    return [c.join(ids, key, "left_anti") for c in children]


def delete_set_null(deleted_ids: DataFrame, child: DataFrame, col: str, dim_key: str = "category_id") -> DataFrame:
    """W11 ``ON DELETE SET NULL``: references to deleted ids become NULL."""
    ids = deleted_ids.select(F.col(dim_key).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    j = child.join(ids, child[col] == F.col("_gone"), "left")
    return j.select(*[F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in child.columns])


def with_engagement_rate(snapshots: DataFrame) -> DataFrame:
    """W13 stored computed column ``chat / NULLIF(viewers, 0)`` at NUMERIC(10,4)."""
    from vantage.functions.scalar import round_num

    return snapshots.withColumn("engagement_rate", round_num(safe_div("chat_messages_delta", "concurrent_viewers"), 4))


def run_summary(outcomes: DataFrame, col: str = "outcome") -> DataFrame:
    """W14 one row: total / added / skipped / failed / not_found."""
    o = F.col(col)
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(o == "added").alias("added"),
        F.count_if(o == "skipped").alias("skipped"),
        F.count_if(o == "failed").alias("failed"),
        F.count_if(o == "not_found").alias("not_found"),
    )


def deactivate(streamers: DataFrame, ids: DataFrame, now=None) -> DataFrame:
    """W16 soft delete: ``is_active = false`` for the ids, history kept."""
    hit = ids.select("streamer_id").distinct().withColumn("_hit", F.lit(True))
    j = streamers.join(hit, "streamer_id", "left")
    out = []
    for c in streamers.columns:
        if c == "is_active":
            out.append(F.when(F.col("_hit"), F.lit(False)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and now is not None:
            out.append(F.when(F.col("_hit"), ts_lit(now)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def maintain_categories(categories: DataFrame, snapshots: DataFrame, unknown_name: str = "Unknown") -> DataFrame:
    """W17 categories seen in snapshots: unseen ids are inserted, and first / last
    seen widen to the observed range."""
    seen = snapshots.filter(F.col("category_id").isNotNull()).groupBy("category_id").agg(
        F.min("snapshot_timestamp").alias("_first"), F.max("snapshot_timestamp").alias("_last")
    )
    base = categories
    for c in ("first_seen_at", "last_seen_at"):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    j = base.join(seen, "category_id", "full_outer")
    out = []
    for c in base.columns:
        if c == "category_name":
            out.append(F.coalesce(F.col(c), F.lit(unknown_name)).alias(c))
        elif c == "first_seen_at":
            out.append(F.least(F.col(c), F.col("_first")).alias(c))
        elif c == "last_seen_at":
            out.append(F.greatest(F.col(c), F.col("_last")).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def last_activity(snapshots: DataFrame, key: str = "streamer_id") -> DataFrame:
    """W18 latest snapshot time per entity (or per category)."""
    return snapshots.groupBy(key).agg(F.max("snapshot_timestamp").alias("last_seen_at"))


def refresh_last_seen(streamers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """W18 ``last_seen_at`` = latest activity (kept when newer or no activity)."""
    la = last_activity(snapshots).withColumnRenamed("last_seen_at", "_seen")
    base = streamers if "last_seen_at" in streamers.columns else streamers.withColumn("last_seen_at", F.lit(None).cast("timestamp_ntz"))
    j = base.join(la, "streamer_id", "left")
    return j.select(*[F.greatest(F.col(c), F.col("_seen")).alias(c) if c == "last_seen_at" else F.col(c) for c in base.columns])


def inactive(df: DataFrame, now, days: int, col: str = "last_seen_at") -> DataFrame:
    """W18 rows not seen for ``days`` days (never seen counts as inactive)."""
    import datetime as dt

    t = dt.datetime.fromisoformat(str(now)) - dt.timedelta(days=days)
    return df.filter(F.col(col).isNull() | (F.col(col) < ts_lit(t)))


def archive_split(snapshots: DataFrame, cutoff, ts: str = "snapshot_timestamp") -> tuple[DataFrame, DataFrame]:
    """A19 ``(archive, live)``: rows strictly older than ``cutoff`` go to the
    archive; the rest, including NULL times, stay live.  A disjoint cover."""
    old = F.col(ts) < ts_lit(cutoff)
    return snapshots.filter(old), snapshots.filter(~F.coalesce(old, F.lit(False)))


def write_snapshots_partitioned(snapshots: DataFrame, path: str, mode: str = "append") -> None:
    """A18 month-partitioned snapshot table, sorted by (entity, time) inside files
    so Parquet min/max statistics skip row groups for entity/time predicates."""
    (
        snapshots.withColumn("snapshot_month", F.date_format("snapshot_timestamp", "yyyy-MM"))
        .repartitionByRange("snapshot_month", "streamer_id", "snapshot_timestamp")
        .sortWithinPartitions("snapshot_month", "streamer_id", "snapshot_timestamp")
        .write.mode(mode)
        .partitionBy("snapshot_month")
        .parquet(path)
    )


def write_stats_partition(stats: DataFrame, path: str) -> None:
    """Write statistics with dynamic partition overwrite of ``calculation_date``:
    rerunning a date replaces exactly that date (idempotent, W3 at table level)."""
    (
        stats.repartitionByRange("calculation_date", "streamer_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("calculation_date")
        .parquet(path)
    )


def bootstrap_entities(streamers: DataFrame, names: DataFrame, profiles: DataFrame, now) -> DataFrame:
    """W15 only when no active entity exists: upsert the configured names (F18
    list) that have a profile (J14); otherwise the table is returned unchanged."""
    has_active = streamers.filter(F.col("is_active")).limit(1).count() > 0
    if has_active:
        return streamers
    wanted = names.select(F.lower("username").alias("_n")).distinct()
    found = profiles.join(wanted, F.lower(profiles["username"]) == wanted["_n"]).drop("_n")
    return upsert_entities(streamers, found.select("streamer_id", "username", "display_name"), now)
