"""The public query surface (Q1-Q22) over the driver tables.

Each query is ``f(tables, **params) -> DataFrame`` over a tables object
(``DriverTables`` for the driver corpus, ``DomainTables`` for domain data); the
registry binds them to ``(spark, sf_dir)``.  Domain tables are derived lazily so
Catalyst prunes whatever a query does not use.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import round_num, safe_div, seconds_between
from vantage.functions.tiers import versatility_rating
from vantage.operators import aggregates as agg
from vantage.operators import filters as flt
from vantage.operators import joins as J
from vantage.operators import lookups as Lk
from vantage.operators import metrics as Mx
from vantage.operators import ml as ML
from vantage.operators import quality as Qa
from vantage.operators import references as Rf
from vantage.operators import topk as K
from vantage.operators import windows as Wn
from vantage.operators import writes as Wr
from vantage.plans import params as P
from vantage.session import reliable_checkpoint
from vantage.sources import landing as L
from vantage.sources.tables import STATS_SCALE, DriverTables, ts_lit
from vantage.streaming import ingest as IG
from vantage.streaming import lifecycle as LC
from vantage.streaming import sessions as SS

def storage_scale(stats: DataFrame) -> DataFrame:
    """Round measures to the declared scale of the statistics table."""
    return stats.select(
        *[round_num(c, STATS_SCALE[c]).alias(c) if c in STATS_SCALE else F.col(c) for c in stats.columns]
    )


def q8_rolling_stats(t, as_of: str = P.AS_OF, window_days: int = P.WINDOW_DAYS) -> DataFrame:
    stats = agg.rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, as_of, window_days)
    return storage_scale(stats)


# ----------------------------------------------------------------- Q1 - Q7, Q18


def _recent_snapshots(t, days, as_of, seconds=None, snapshots=None):
    """Snapshots that can belong to sessions started after the cut: when snapshot
    times follow session starts the same bound prunes the snapshot scan."""
    s = t.snapshots if snapshots is None else snapshots
    if not getattr(t, "snapshots_follow_start", False):
        return s
    if seconds is not None:
        return flt.trailing_interval(s, "snapshot_timestamp", as_of, seconds)
    return flt.trailing_days(s, "snapshot_timestamp", as_of, days) if days else s


def _recent_star(t: DriverTables, days: int, as_of: str, by=(), primary=False, entity_cols=("username",)):
    """Sessions started in the trailing window ⋈ snapshots at session grain ⋈ entity."""
    b = flt.trailing_days(t.broadcasts(with_primary_category=primary), "started_at", as_of, days) if days else t.broadcasts(primary)
    snaps = _recent_snapshots(t, days, as_of)
    grain = J.session_grain(snaps.select("broadcast_id", "concurrent_viewers", "chat_messages_delta", *by), by)
    return J.star_join(t.streamers, b, grain, entity_cols)


def q1_high_engagement(t, as_of=P.AS_OF, days=P.RECENT_DAYS, min_engagement=5.0):
    j = _recent_star(t, days, as_of, primary=True, entity_cols=("username", "display_name"))
    g = j.groupBy("streamer_id", "username", "display_name").agg(
        F.count("broadcast_id").alias("total_broadcasts"),
        F.count_distinct("primary_category_id").alias("categories_played"),
        J.avg_engagement().alias("_eng"),
        J.stddev_engagement().alias("_sd"),
        J.avg_viewers().alias("_v"),
    )
    return (
        g.filter(F.col("_eng") > min_engagement)
        .select(
            "username",
            "display_name",
            "total_broadcasts",
            "categories_played",
            round_num("_eng", 3).alias("avg_engagement_rate"),
            round_num("_sd", 3).alias("engagement_consistency"),
            round_num("_v", 0).alias("avg_viewers"),
        )
        .orderBy(F.col("avg_engagement_rate").desc_nulls_first(), "username")
    )


def q2_category_independent(t, as_of=P.AS_OF, days=P.RECENT_DAYS_Q2, min_sessions=2, min_categories=2):
    snaps, tasks = t.spread_snapshots()
    snaps = _recent_snapshots(t, days, as_of, snapshots=snaps)
    b = flt.trailing_days(t.broadcasts(), "started_at", as_of, days) if days else t.broadcasts()
    grain = J.session_grain(snaps.select("broadcast_id", "concurrent_viewers", "chat_messages_delta", "category_id"), ("category_id",))
    j = J.category_star(t.streamers, b, t.categories, grain, ("category_name",), tasks)
    perf = j.groupBy("streamer_id", "username", "category_name").agg(
        J.avg_viewers().alias("avg_viewers_in_category"),
        J.avg_engagement().alias("avg_engagement_in_category"),
        F.count_distinct("broadcast_id").alias("broadcasts_in_category"),
    )
    e = F.col("avg_engagement_in_category")
    ent = (
        perf.filter(F.col("broadcasts_in_category") >= min_sessions)
        .groupBy("username", "streamer_id")
        .agg(
            F.count_distinct("category_name").alias("categories_count"),
            F.avg(e).alias("_avg"),
            F.stddev_samp(e).alias("_sd"),
            F.min(e).alias("_min"),
            F.max(e).alias("_max"),
        )
        .filter(F.col("categories_count") >= min_categories)
    )
    return ent.select(
        "username",
        "categories_count",
        round_num("_avg", 3).alias("overall_avg_engagement"),
        round_num("_sd", 3).alias("engagement_variance"),
        round_num("_min", 3).alias("min_category_engagement"),
        round_num("_max", 3).alias("max_category_engagement"),
        versatility_rating("_sd").alias("versatility_rating"),
    ).orderBy(F.col("engagement_variance").asc_nulls_last(), F.col("overall_avg_engagement").desc_nulls_first(), "username")


def q3_hype_dependency(t, fanout="reference"):
    snaps, tasks = t.spread_snapshots()
    grain = J.session_grain(snaps.select("broadcast_id", "category_id", "concurrent_viewers", "chat_messages_delta"), ("category_id",))
    j = J.category_star(t.streamers, t.broadcasts(), t.categories, grain, ("category_name", "is_trending"), tasks)
    g = j.groupBy("streamer_id", "username", "category_id", "category_name", "is_trending").agg(
        (J.rows() if fanout == "reference" else F.count_distinct("broadcast_id")).alias("broadcasts_count"),
        round_num(J.avg_viewers(), 0).alias("avg_viewers"),
        round_num(J.avg_engagement(), 3).alias("engagement_rate"),
        J.fanout_sum("follower_gain", "reference" if fanout == "reference" else "session").alias("total_followers_gained"),
    )
    out = g.select(
        "username", "category_name", "is_trending", "broadcasts_count", "avg_viewers", "engagement_rate", "total_followers_gained"
    )
    return J.ordered(out, tasks, "username", F.col("is_trending").desc_nulls_first(), F.col("avg_viewers").desc_nulls_first(), "category_name")


def _velocity_aggs(fanout: str):
    gain = J.fanout_sum("follower_gain", fanout)
    secs = J.fanout_sum("duration_seconds", fanout)
    hours = secs / F.lit(3600.0)
    return gain, hours


def q4_follower_velocity(t, as_of=P.AS_OF, days=P.RECENT_DAYS, fanout="reference"):
    j = _recent_star(t, days, as_of)
    gain, hours = _velocity_aggs(fanout)
    g = j.groupBy("streamer_id", "username").agg(
        gain.alias("total_follower_gain"), hours.alias("_h"), J.avg_viewers().alias("_v")
    )
    vel = safe_div("total_follower_gain", "_h")
    return g.select(
        "username",
        "total_follower_gain",
        round_num("_h", 1).alias("total_hours_streamed"),
        round_num(vel, 2).alias("follower_velocity"),
        round_num("_v", 0).alias("avg_viewers"),
        round_num(safe_div(vel, "_v") * F.lit(100.0), 3).alias("efficiency_score"),
    ).orderBy(F.col("follower_velocity").desc_nulls_first(), "username")


def q5_hidden_gem_score(t, as_of=P.AS_OF, days=P.RECENT_DAYS, k=10, fanout="reference"):
    j = _recent_star(t, days, as_of, primary=True, entity_cols=("username", "display_name"))
    gain, hours = _velocity_aggs(fanout)
    m = j.groupBy("streamer_id", "username", "display_name").agg(
        J.avg_engagement().alias("eng"),
        J.stddev_engagement().alias("sd"),
        safe_div(gain, hours).alias("vel"),
        F.count_distinct("primary_category_id").alias("unique_categories"),
        J.avg_viewers().alias("v"),
    )
    score = (
        F.col("eng") * 20
        + F.col("vel") * 10
        + F.col("unique_categories") * 15
        + F.when(F.col("sd") < 1, 20).otherwise(0)
        + F.when(F.col("v") < 200, 30).otherwise(0)
        + F.when(F.col("v") > 1000, -50).otherwise(0)
    )
    out = m.select(
        "username",
        "display_name",
        round_num("eng", 3).alias("engagement_rate"),
        round_num("sd", 3).alias("engagement_consistency"),
        round_num("vel", 2).alias("follower_velocity"),
        "unique_categories",
        round_num("v", 0).alias("avg_viewers"),
        round_num(score, 2).alias("hidden_gem_score"),
    )
    return out.orderBy(F.col("hidden_gem_score").desc_nulls_first(), "username").limit(k)


def q6_retention_curve(t):
    return Wn.retention_curve(t.snapshots)


def q7_category_switch_impact(t):
    cs = flt.switch_only(Wn.category_switches(t.snapshots))
    b = t.broadcasts().select("broadcast_id", "streamer_id")
    j = cs.join(b, "broadcast_id").join(t.streamers.select("streamer_id", "username"), "streamer_id")
    j = J.role_playing(j, t.categories, "prev_category_id", "from_category")
    j = J.role_playing(j, t.categories, "category_id", "to_category")
    change = F.col("concurrent_viewers") - F.col("prev_viewers")
    return j.select(
        "streamer_id",
        "username",
        "from_category",
        "to_category",
        F.col("prev_viewers").alias("viewers_before_switch"),
        F.col("concurrent_viewers").alias("viewers_after_switch"),
        change.alias("viewer_change"),
        round_num(safe_div(change, "prev_viewers") * F.lit(100.0), 1).alias("percent_change"),
    ).orderBy(F.col("viewer_change").desc_nulls_first())


def q18_quick_counts(t):
    grain = J.session_grain(t.snapshots.select("broadcast_id", "concurrent_viewers", "chat_messages_delta"))
    j = J.star_join(t.streamers, t.broadcasts(), grain)
    return (
        j.groupBy("username")
        .agg(J.rows().alias("broadcast_count"), round_num(J.avg_viewers(), 0).alias("avg_viewers"))
        .orderBy(F.col("avg_viewers").desc_nulls_first(), "username")
    )


# ------------------------------------------------------ statistics consumers


def v8_stats_history(t, dates=P.STATS_DATES, window_days=P.WINDOW_DAYS):
    first, last, step = dates
    return storage_scale(agg.stats_history(t.streamers, t.broadcasts(), t.snapshots, first, last, step, window_days))


def v8_daily_history(t, dates=P.DAILY_DATES, window_days=P.DAILY_WINDOW):
    """V8 with a step of one day and the reference's window of 30 days."""
    return v8_stats_history(t, dates, window_days)


def _stats_on(t, as_of, window_days=P.WINDOW_DAYS, snapshots=None):
    """The statistics rows of one calculation date (as the daily job writes them)."""
    s = t.snapshots if snapshots is None else snapshots
    return storage_scale(agg.rolling_statistics(t.streamers, t.broadcasts(), s, as_of, window_days))


def q9_daily_stats_ddl(t, as_of=P.AS_OF, days=P.RECENT_DAYS):
    """All entities (left joins), sessions started after ``as_of - days``,
    chat rate as the mean of per-snapshot rates, velocity with the fan-out."""
    rate = safe_div("chat_messages_delta", "concurrent_viewers") / F.lit(agg.SNAPSHOT_HOURS)
    grain = _recent_snapshots(t, days, as_of).groupBy("broadcast_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(rate).alias("n_rate"), F.sum(rate).alias("sum_rate")
    )
    b = flt.trailing_days(t.broadcasts().select("broadcast_id", "streamer_id", "started_at", "duration_seconds", "follower_gain"), "started_at", as_of, days)
    sess = b.join(grain, "broadcast_id", "left").withColumn("_w", F.coalesce("n_rows", F.lit(1)))
    per = sess.groupBy("streamer_id").agg(
        F.count("broadcast_id").alias("total_broadcasts"),
        safe_div(F.sum("sum_rate"), F.sum("n_rate")).alias("_rate"),
        safe_div(F.sum(F.col("follower_gain") * F.col("_w")), F.sum(F.col("duration_seconds") * F.col("_w")) / F.lit(3600.0)).alias("_vel"),
    )
    j = t.streamers.select("streamer_id").join(per, "streamer_id", "left")
    return j.select(
        "streamer_id",
        F.lit(as_of).cast("date").alias("calculation_date"),
        F.coalesce("total_broadcasts", F.lit(0)).alias("total_broadcasts"),
        round_num("_rate", 4).alias("average_chat_rate"),
        round_num("_vel", 2).alias("follower_velocity"),
    )


def q10_training_set(t, dates=P.STATS_DATES, window_days=P.WINDOW_DAYS, label_threshold=P.LABEL_THRESHOLD, min_hours=P.MIN_HOURS):
    from vantage.operators.ml import training_set

    stats = v8_stats_history(t, dates, window_days)
    return training_set(stats, label_threshold, min_hours)


def q11_top_chat_rate(t, as_of=P.AS_OF, k=10):
    s = _stats_on(t, as_of).join(t.streamers.select("streamer_id", "username"), "streamer_id")
    return s.select("username", "avg_chat_rate", "avg_concurrent_viewers", "total_broadcasts").orderBy(
        F.col("avg_chat_rate").desc_nulls_first(), "username"
    ).limit(k)


def q12_growth_history(t, dates=P.STATS_DATES, window_days=P.WINDOW_DAYS, n=30):
    h = Wn.history(v8_stats_history(t, dates, window_days), n)
    return h.select("streamer_id", "calculation_date", "follower_gain_30d", "follower_velocity", "total_broadcast_hours")


def q13_hidden_gems(t, as_of=P.AS_OF, k=20):
    s = flt.hidden_gem_filter(_stats_on(t, as_of)).join(t.streamers.select("streamer_id", "username"), "streamer_id")
    return s.select("username", "avg_chat_rate", "avg_concurrent_viewers", "follower_velocity", "unique_categories").orderBy(
        F.col("avg_chat_rate").desc_nulls_first(), "username"
    ).limit(k)


def q14_multi_category_gems(t, now=P.AS_OF, days=P.MULTI_CAT_DAYS, min_categories=3, min_engagement=5.0, k=10):
    b = flt.trailing_interval(t.broadcasts(with_primary_category=True), "started_at", now, days * 86400)
    snaps = _recent_snapshots(t, days, now, seconds=days * 86400)
    grain = J.session_grain(snaps.select("broadcast_id", "concurrent_viewers", "chat_messages_delta"))
    j = J.star_join(t.streamers, b, grain)
    g = j.groupBy("streamer_id", "username").agg(
        F.count_distinct("primary_category_id").alias("categories_count"),
        J.avg_engagement().alias("_eng"),
        J.avg_viewers().alias("_v"),
    )
    return (
        g.filter((F.col("categories_count") >= min_categories) & (F.col("_eng") > min_engagement))
        .select("username", "categories_count", round_num("_eng", 3).alias("avg_engagement"), round_num("_v", 0).alias("avg_viewers"))
        .orderBy(F.col("avg_engagement").desc_nulls_first(), "username")
        .limit(k)
    )


# ------------------------------------------- discovery, freshness, bulk add


def q15_discoveries_per_day(t):
    return (
        t.streamers.groupBy(F.to_date("discovered_at").alias("discovery_date"))
        .agg(F.count(F.lit(1)).alias("streamers_added"))
        .orderBy(F.col("discovery_date").desc())
    )


def q16_recent_account_age(t, now=P.NOW, days=P.DISCOVERY_RECENT_DAYS):
    recent = flt.trailing_interval(t.streamers, "discovered_at", now, days * 86400)
    age_days = F.timestamp_diff("MICROSECOND", F.col("account_created_at"), ts_lit(now)) / F.lit(86400e6)
    return recent.agg(F.count(F.lit(1)).alias("total"), round_num(F.avg(age_days), 0).cast("int").alias("avg_account_age_days"))


def q17_recent_active(t, k=10):
    a = t.streamers.filter(F.col("is_active")).select("streamer_id", "username", "display_name", "discovered_at", "is_active")
    return K.top_k(a, [F.col("discovered_at").desc_nulls_first(), F.col("streamer_id")], k)


def q19_snapshot_freshness(t, now=P.NOW, seconds=P.FRESHNESS_SECONDS):
    recent = flt.trailing_interval(t.snapshots, "snapshot_timestamp", now, seconds)
    return recent.agg(F.count(F.lit(1)).alias("snapshots_recent"), F.max("snapshot_timestamp").alias("latest_snapshot"))


def e19_stats_freshness(t, dates=P.STATS_DATES, expected=P.AS_OF):
    h = v8_stats_history(t, dates)
    return h.agg(F.max("calculation_date").alias("latest_calculation_date")).select(
        "latest_calculation_date",
        F.lit(expected).cast("date").alias("expected_date"),
        (F.col("latest_calculation_date") >= F.lit(expected).cast("date")).alias("up_to_date"),
    )


def _profiles(t):
    """J14 profile lookup (the user directory), keyed by user id."""
    return t.streamers.select(F.col("streamer_id").alias("user_id"), "display_name")


def _tracked(t):
    """The stored entities of the discovery and bulk-add runs: the active ones; the
    directory of profiles is everyone."""
    return t.streamers.filter(F.col("is_active"))


def q20_discovery_candidates(t, lo=P.MIN_LISTING_VIEWERS, hi=P.MAX_LISTING_VIEWERS, limit=P.DISCOVERY_LIMIT):
    """Dry run of discovery (W12): the first ``limit`` listed streams per category
    in the viewer range that have a profile; the dry run skips the tracked test."""
    flt.validate_range(lo, hi, limit)
    listing = L.live_listing(t.events).join(_profiles(t), "user_id")
    in_range = flt.in_viewer_range(lo, hi)
    chosen, _ = K.quota(listing, "game_id", "listing_pos", in_range, F.lit(False), limit)
    return chosen.select(
        "game_id", "user_id", "user_login", "display_name", "viewer_count",
        F.col("listing_pos.event_time").alias("listed_at"), F.col("listing_pos.event_id").alias("listing_event_id"),
    )


def q20_discovery_summary(t, lo=P.MIN_LISTING_VIEWERS, hi=P.MAX_LISTING_VIEWERS, limit=P.DISCOVERY_LIMIT):
    """Real run: streams already tracked are skipped (J9 semi/anti), streams
    without a profile are passed over, ``limit`` new entities per category."""
    tracked = _tracked(t).select(F.col("streamer_id").alias("user_id")).withColumn("_tracked", F.lit(True))
    listing = (
        L.live_listing(t.events)
        .join(tracked, "user_id", "left")
        .join(_profiles(t).withColumn("_profile", F.lit(True)), "user_id", "left")
    )
    flt.validate_range(lo, hi, limit)
    in_range = flt.in_viewer_range(lo, hi)
    is_tracked = F.coalesce("_tracked", F.lit(False))
    eligible = in_range & ~is_tracked & F.coalesce("_profile", F.lit(False))
    _, summary = K.quota(listing, "game_id", "listing_pos", eligible, in_range & is_tracked, limit)
    return summary.select("game_id", "processed", "skipped", "added")


def _bulk_add_outcomes(t):
    # channels seen in chat, and names that no directory profile has
    requested = (
        L.chat_events(t.events).select(F.col("channel").alias("requested_username"))
        .unionByName(t.raw("supplier").select(F.col("s_name").alias("requested_username")))
        .distinct()
    )
    profiles = t.streamers.select("streamer_id", F.lower("username").alias("_login"))
    found = requested.join(profiles, F.lower("requested_username") == F.col("_login"), "left")
    exists = _tracked(t).select("streamer_id").withColumn("_exists", F.lit(True))
    j = found.join(exists, "streamer_id", "left")
    outcome = (
        F.when(F.col("_login").isNull(), "not_found").when(F.col("_exists"), "skipped").otherwise("added")
    )
    return j.select("requested_username", "streamer_id", outcome.alias("outcome"))


def q21_bulk_add(t):
    """Bulk add by username (J10 case-insensitive, W1 insert-ignore)."""
    return _bulk_add_outcomes(t)


def q21_bulk_add_summary(t):
    """W14 run summary of the bulk add."""
    return Wr.run_summary(_bulk_add_outcomes(t))


# --------------------------------------------------- writes and data quality


def w1_replay_insert_ignore(t, as_of=P.AS_OF, replay_days=P.REPLAY_DAYS):
    """The ingestion re-sends the last ``replay_days`` of snapshots; rows
    whose (session, time) key is stored already, and repeats inside the batch,
    are ignored."""
    cut = _dt.date.fromisoformat(as_of)
    snaps = t.snapshots
    stored = snaps.filter(F.col("snapshot_timestamp") < ts_lit(cut))
    incoming = snaps.filter(F.col("snapshot_timestamp") >= ts_lit(cut - _dt.timedelta(days=replay_days)))
    inserted, _ = Wr.insert_ignore(stored, incoming, ["broadcast_id", "snapshot_timestamp"])
    return inserted


def w3_upsert_stats(t, dates=P.STATS_DATES, as_of=P.AS_OF, now=P.NOW):
    """Recompute ``as_of`` with a 30-day window and upsert it into the history."""
    stored = F.col("calculation_date").cast("timestamp_ntz")
    history = v8_stats_history(t, dates).withColumns({"created_at": stored, "calculated_at": stored})
    fresh = storage_scale(agg.rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, as_of, 30))
    return Wr.upsert_stats(history, fresh, now)


def w7_quarantine(t):
    """W7 rows failing a CHECK rule, with the rules: sessions that end at their last
    snapshot, with their rollup measures, and snapshots whose message count is
    taken over one message per viewer."""
    last = t.snapshots.groupBy("broadcast_id").agg(F.max("snapshot_timestamp").alias("ended_at"))
    b = t.broadcasts().select("broadcast_id", "started_at").join(last, "broadcast_id").join(agg.session_rollup(t.snapshots), "broadcast_id")
    b = b.withColumn("duration_seconds", seconds_between("started_at", "ended_at"))
    s = t.snapshots.withColumn("chat_messages_delta", F.col("chat_messages_delta") - F.col("concurrent_viewers"))
    _, qb = Qa.validate_checks(b, Qa.CHECKS["broadcasts"])
    _, qs = Qa.validate_checks(s, Qa.CHECKS["broadcast_snapshots"])
    return qb.select(F.lit("broadcasts").alias("table_name"), F.col("broadcast_id").alias("row_key"), F.array_join("failed_checks", ",").alias("failed")).unionByName(
        qs.select(F.lit("broadcast_snapshots").alias("table_name"), F.col("broadcast_id").alias("row_key"), F.array_join("failed_checks", ",").alias("failed"))
    )


def w8_duplicate_snapshot_keys(t):
    """W8 (session, time) keys that occur more than once."""
    return Qa.duplicate_keys(t.snapshots, ["broadcast_id", "snapshot_timestamp"])


def w8_entity_violations(t):
    """W8 NOT NULL / VARCHAR(n) violations of the entity table."""
    v = Qa.validate_not_null_length(t.streamers, "streamers", P.ENTITY_LENGTHS)
    return v.select("streamer_id", F.array_join("violations", ",").alias("violations"))


def w9_orphans(t):
    """W9 references without a parent, per foreign key and missing id; the parents are
    the closed sessions, the active entities and the trending categories."""
    s, b = t.snapshots, t.broadcasts()
    closed, trending = b.filter(F.col("ended_at").isNotNull()), t.categories.filter(F.col("is_trending"))
    parts = [
        ("broadcast_snapshots.broadcast_id", Qa.validate_fk(s, closed, "broadcast_id"), "broadcast_id"),
        ("broadcast_snapshots.streamer_id", Qa.validate_fk(s, _tracked(t), "streamer_id"), "streamer_id"),
        ("broadcast_snapshots.category_id", Qa.validate_fk(s, trending, "category_id"), "category_id"),
        ("broadcasts.streamer_id", Qa.validate_fk(b, _tracked(t), "streamer_id"), "streamer_id"),
    ]
    out = None
    for name, df, key in parts:
        c = df.groupBy(F.lit(name).alias("foreign_key"), F.col(key).alias("missing_id")).agg(F.count(F.lit(1)).alias("orphans"))
        out = c if out is None else out.unionByName(c)
    return out


def w17_maintain_categories(t):
    """The trending categories are stored; the others first appear in snapshots."""
    return Wr.maintain_categories(t.categories.filter(F.col("is_trending")), t.snapshots.select("category_id", "snapshot_timestamp"))


def _inactive_entities(t, now, days):
    seen = Wr.refresh_last_seen(t.streamers.select("streamer_id", "username"), t.snapshots.select("streamer_id", "snapshot_timestamp"))
    return Wr.inactive(seen, now, days)


def w18_inactive_entities(t, now=P.NOW, days=P.INACTIVE_DAYS):
    return _inactive_entities(t, now, days).select("streamer_id", "username", "last_seen_at")


def w16_deactivate_inactive(t, now=P.NOW, days=P.INACTIVE_DAYS):
    st = Wr.deactivate(t.streamers.select("streamer_id", "is_active"), _inactive_entities(t, now, days))
    return st


def w4_create_sessions(t):
    """The session rows that the online events create, and how many of them share
    an id (one each; a replay of the events gives the same ids and adds none)."""
    online = _lifecycle(t).filter(F.col("kind") == "online")
    created = Wr.create_sessions(online.unionByName(online))
    ids = created.groupBy("broadcast_id", "streamer_id", "started_at", "stream_title", "primary_category_id", "ended_at").agg(
        (F.count(F.lit(1)) / 2).cast("bigint").alias("events")
    )
    shared = ids.groupBy("broadcast_id").agg(F.count(F.lit(1)).alias("sessions_of_id"))
    return ids.join(shared, "broadcast_id").drop("broadcast_id")


def q20_short_discovery(t, limit=P.SHORT_DISCOVERY_LIMIT):
    """Q20 / K5 with a limit that cuts: the summary per category."""
    return q20_discovery_summary(t, limit=limit)


def w10_delete_cascade(t, now=P.NOW, days=P.INACTIVE_DAYS):
    """W10 delete the inactive entities with their sessions and snapshots;
    report the rows that remain."""
    gone = _inactive_entities(t, now, days).select("streamer_id")
    b, s = Wr.delete_cascade(gone, "streamer_id", t.broadcasts().select("broadcast_id", "streamer_id"), t.snapshots.select("streamer_id"))
    e = t.streamers.select("streamer_id").join(gone, "streamer_id", "left_anti")
    rows = [("streamers", e), ("broadcasts", b), ("broadcast_snapshots", s)]
    out = None
    for name, df in rows:
        c = df.agg(F.count(F.lit(1)).alias("remaining_rows")).select(F.lit(name).alias("table_name"), "remaining_rows")
        out = c if out is None else out.unionByName(c)
    return out


def _referring_tables(t, as_of=P.AS_OF):
    stats = agg.extended_statistics(t.broadcasts(with_primary_category=True), t.snapshots, as_of, P.WINDOW_DAYS)
    return {
        "streamers": t.streamers.select("streamer_id"),
        "categories": t.categories.select("category_id"),
        "broadcasts": t.broadcasts(with_primary_category=True).select("broadcast_id", "streamer_id", "primary_category_id"),
        "broadcast_snapshots": t.snapshots.select("broadcast_id", "streamer_id", "snapshot_timestamp", "category_id"),
        "streamer_statistics": stats.select("streamer_id", F.lit(as_of).cast("date").alias("calculation_date"), "top_category_id"),
    }


def _keys_by_row(marked):
    """Deleted and cleared keys; equal ones (one instant may hold several) counted."""
    return Rf.touched_keys(marked).groupBy("table_name", "effect", "id", "place").agg(F.count(F.lit(1)).alias("row_count"))


def w10_cascade_keys(t, now=P.NOW, days=P.INACTIVE_DAYS):
    """W10 the keys of all rows that go with the inactive entities, in every table that
    refers to them."""
    return _keys_by_row(Rf.delete_rows(_referring_tables(t), "streamers", _inactive_entities(t, now, days)))


def w11_nulled_keys(t, now=P.NOW, days=P.INACTIVE_DAYS):
    """W11 the keys of the rows, and which of their columns lose a category that is
    deleted: the session's primary one, the snapshot's, the statistics' top one."""
    seen = Wr.last_activity(t.snapshots.select("category_id", "snapshot_timestamp"), "category_id")
    gone = Wr.inactive(t.categories.select("category_id").join(seen, "category_id", "left"), now, days)
    return _keys_by_row(Rf.delete_rows(_referring_tables(t), "categories", gone))


def w11_delete_set_null(t, now=P.NOW, days=P.INACTIVE_DAYS):
    """W11 delete categories without a snapshot in the last ``days`` days; the
    snapshots that referenced them keep their rows with a NULL category."""
    seen = Wr.last_activity(t.snapshots.select("category_id", "snapshot_timestamp"), "category_id")
    cats = t.categories.select("category_id").join(seen, "category_id", "left")
    gone = Wr.inactive(cats, now, days)
    s = Wr.delete_set_null(gone, t.snapshots.select("broadcast_id", "category_id"), "category_id")
    return s.agg(F.count(F.lit(1)).alias("snapshots"), F.count_if(F.col("category_id").isNull()).alias("category_nulled"))


def a19_archive_split(t, now=P.NOW, days=P.ARCHIVE_AFTER_DAYS):
    cutoff = _dt.datetime.fromisoformat(now) - _dt.timedelta(days=days)
    archive, live = Wr.archive_split(t.snapshots.select("snapshot_timestamp"), cutoff)
    a = archive.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("archive").alias("part"), "row_count")
    lv = live.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("live").alias("part"), "row_count")
    return a.unionByName(lv)


# ------------------------------------------------ ingestion (batch twins)


def _lifecycle(t):
    return L.lifecycle_events(t.events)


def _sessions(t):
    return LC.sessionize_batch(_lifecycle(t))


def _attached(t):
    """Tracked chat messages (counted between lifecycle events and samples, J12) and poll
    samples attached to their sessions in one pass over the lifecycle stack (S4) that
    carries their columns along; stored once and split by ``_src``."""
    chat = LC.filter_chat(L.chat_events(t.events), t.streamers.filter(F.col("is_active")))
    polls = L.poll_samples(t.events)
    chat = LC.precount(chat, _lifecycle(t), polls)
    both = chat.withColumn("_src", F.lit("chat")).unionByName(polls.withColumn("_src", F.lit("poll")), allowMissingColumns=True)
    a = reliable_checkpoint(LC.attach_session(both, _lifecycle(t), _sessions(t)))
    pick = lambda src, like: a.filter(F.col("_src") == src).select(*like.columns, "broadcast_id", "started_at")
    return pick("chat", chat), pick("poll", polls)


def _chat_attached(t):
    return _attached(t)[0]


def s3_sessionize(t):
    return _sessions(t).drop("broadcast_id")


def s2_dropped_offline(t):
    return LC.dropped_offline(_lifecycle(t))


def s8_orphan_sessions(t):
    return LC.orphan_sessions(_sessions(t)).select("streamer_id", "level", "session_seq", "started_at")


def s4_chat_per_session(t):
    """S4 + S9: tracked, non-echo chat messages attached to the open session."""
    a = _chat_attached(t).filter(F.col("broadcast_id").isNotNull())
    return a.groupBy("streamer_id", "started_at").agg(
        F.sum("n").alias("messages"), F.min("event_time").alias("first_message"), F.max("last_time").alias("last_message")
    )


def s5_chat_delta_carry_over(t):
    chat, polls = _attached(t)
    d = LC.chat_delta_carry_over(chat, polls)
    return d.join(polls.select(F.col("event_id").alias("poll_event_id"), "streamer_id", "started_at"), "poll_event_id").select(
        "poll_event_id", "streamer_id", "started_at", "chat_messages_delta"
    )


def s6_snapshot_ticks(t, minutes=P.TICK_MINUTES):
    chat, polls = _attached(t)
    s = LC.snapshot_ticks(polls, chat, minutes)
    started = _sessions(t).select("broadcast_id", "started_at")
    return s.join(started, "broadcast_id").drop("broadcast_id")


def s15_poll_outcomes(t, minutes=P.TICK_MINUTES):
    return LC.poll_outcomes(L.poll_samples(t.events), minutes)


# ------------------------------------------------- extended statistics, windows

def e20_session_rollup(t):
    return agg.session_rollup(t.snapshots)


def e21_e26_extended_stats(t, as_of=P.AS_OF, window_days=P.WINDOW_DAYS):
    x = agg.extended_statistics(t.broadcasts(with_primary_category=True), t.snapshots, as_of, window_days)
    return x.select("streamer_id", *[round_num(c, 6).alias(c) if c not in ("top_category_id",) else F.col(c) for c in x.columns[1:]])


def m18_candidate_features(t, as_of=P.AS_OF, window_days=P.WINDOW_DAYS):
    x = agg.candidate_features(t.broadcasts(), t.snapshots, as_of, window_days)
    return x.select("streamer_id", *[round_num(c, 6).alias(c) for c in x.columns[1:]])


def v5_viewer_rank(t):
    return Wn.viewer_rank(t.snapshots.select("broadcast_id", "snapshot_timestamp", "concurrent_viewers"))


def v6_follower_delta(t):
    d = Wn.follower_delta(t.snapshots.select(*J.SNAPSHOT_ORDER, "broadcast_id"))
    return d.select("broadcast_id", "snapshot_timestamp", "follower_count", "follower_delta", round_num("follower_delta_per_hour", 6).alias("follower_delta_per_hour"))


# ------------------------------------------------------------- model and metrics


def _training(t):
    return q10_training_set(t)


def _baseline_scored(t):
    """A fixed, model-free scorer (average viewers / 50, capped at 1; positive at
    0.5) so the metric operators can be checked against SQL."""
    s = F.least(F.col("first_30d_avg_viewers") / F.lit(50.0), F.lit(1.0))
    return _training(t).select(
        "streamer_id", F.col(ML.LABEL).alias("label"), s.alias("score"), (s >= 0.5).cast("int").alias("prediction")
    )


def e28_class_distribution(t):
    return Mx.class_distribution(_training(t))


def e29_null_profile(t):
    return Mx.null_profile(_training(t), list(ML.FEATURES))


def e30_describe(t):
    d = Mx.describe(_training(t), list(ML.FEATURES))
    return d.select("feature", "count", *[round_num(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def m5_scaler_params(t):
    """M5 the scaler's fitted values: mean and population std per feature (one pass)."""
    tr = _training(t)
    wide = tr.agg(
        *[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("std_pop")).alias(c) for c in ML.FEATURES]
    )
    long = wide.select(F.explode(F.array(*[F.col(c) for c in ML.FEATURES])).alias("x")).select("x.*")
    return long.select("feature", round_num("mean", 6).alias("mean"), round_num("std_pop", 6).alias("std_pop"))


def m6_split_counts(t, test_fraction=0.2, seed=42):
    from vantage.operators.model import stratified_split

    s = stratified_split(_training(t), ML.LABEL, test_fraction=test_fraction, seed=seed)
    return s.groupBy(ML.LABEL, "is_test").agg(F.count(F.lit(1)).alias("row_count"))


def m7_class_weight(t, test_fraction=0.2, seed=42):
    from vantage.operators.model import stratified_split

    tr = stratified_split(_training(t), ML.LABEL, test_fraction=test_fraction, seed=seed).filter(~F.col("is_test"))
    g = tr.agg(F.count_if(F.col(ML.LABEL) == 0).alias("n_negative"), F.count_if(F.col(ML.LABEL) == 1).alias("n_positive"))
    return g.withColumn("positive_weight", F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")).otherwise(1.0))


def e31_score_distribution(t):
    return Mx.score_distribution(_baseline_scored(t))


def e33_precision_recall(t):
    from vantage.functions.tiers import assess_model

    p = Mx.precision_recall_f1(_baseline_scored(t))
    return p.select("tn", "fp", "fn", "tp", *[round_num(c, 6).alias(c) for c in ("precision", "recall", "f1")], assess_model("precision", "recall").alias("assessment"))


def e34_classification_report(t):
    r = Mx.classification_report(_baseline_scored(t))
    return r.select("class", *[round_num(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def e35_roc_auc(t):
    return Mx.roc_auc(_baseline_scored(t)).select(round_num("roc_auc", 6).alias("roc_auc"))


def e36_pr_curve(t):
    c = Mx.pr_curve(_baseline_scored(t))
    return c.select("threshold", "tp", "fp", *[round_num(x, 6).alias(x) for x in ("precision", "recall", "f1")])


def m15_best_threshold(t):
    b = Mx.best_threshold(Mx.pr_curve(_baseline_scored(t)))
    return b.select("threshold", round_num("f1", 6).alias("f1"))


_MODELS: dict = {}


def _trained(t):
    """Train once per (session, data folder) within a process; the fit is the
    expensive part and several registered queries read the same model."""
    from vantage.operators.model import train

    spark = getattr(t, "spark", None)
    app = spark.conf.get("spark.app.id", None) if spark is not None else None
    key = (id(spark), app, getattr(t, "root", id(t)))
    if key not in _MODELS:
        training = _training(t)
        _MODELS[key] = train(training) | {"training": training}
    return _MODELS[key]


def m17_train_evaluate(t):
    """Classification report of the boosted trees on the test split."""
    from vantage.operators.model import evaluate

    ev = evaluate(_trained(t)["predictions"])
    return ev["report"]


def m12_feature_importance(t):
    from vantage.operators.model import feature_importance

    imp = feature_importance(_trained(t)["model"])
    return t.spark.createDataFrame(imp, "feature string, importance double")


def q22_batch_scoring(t):
    """Q22: score every entity's first-record features with the trained model."""
    from vantage.operators.model import score

    found = _trained(t)
    return score(found["model"], found["training"].drop(ML.LABEL, "tune_in_ratio"))


def m12_importance_checks(t):
    """The features that have an importance, that it is not negative, and that all
    sum to one."""
    imp = m12_feature_importance(t)
    total = imp.agg(F.abs(F.sum("importance") - 1) < 1e-9).scalar()
    return imp.select("feature", (F.col("importance") >= 0).alias("not_negative"), total.alias("sums_to_one"))


def m17_report_checks(t):
    """The lines of the test report with their support, and whether every
    measure lies between 0 and 1."""
    inside = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return m17_train_evaluate(t).select("class", "support", (inside("precision") & inside("recall") & inside("f1")).alias("in_range"))


def q22_score_checks(t):
    """Q22: every entity once with its features, and whether score, decision, tier and
    rank agree with each other."""
    s = q22_batch_scoring(t)
    p = F.col("mega_streamer_score")
    same = F.when(p != 0.5, (p > 0.5).cast("int") == F.col("mega_streamer_prediction")).otherwise(F.lit(True))
    s = s.withColumn("_band", F.when(p >= 0.8, 5).when(p >= 0.6, 4).when(p >= 0.4, 3).when(p >= 0.2, 2).otherwise(1))
    tiers = s.groupBy("tier").agg((F.min("_band") == F.max("_band")).alias("tier_by_score"))  # a row per tier
    return s.join(tiers, "tier").select("streamer_id", *ML.RAW_FEATURES, (p.between(0, 1) & same).alias("decided_by_score"), "tier_by_score")


# ------------------------------------------------ streaming runs (availableNow)


def _event_stream(t):
    path = f"{t.root.rstrip('/')}/events.parquet"
    return IG.event_stream(t.spark, path, t.events.schema)


def _live(t, added_later=None):
    """Records of the live service (and its folder) after a replay of all events: they
    arrive up to six hours late in three slices of time, each taken in by a run of its
    own that resumes the state of the one before.  Entities that ``added_later`` holds
    for join the tracked set between the first two slices."""
    from vantage.streaming import service as SV

    root = IG.stream_root(t.spark)
    events = L.service_events(t.events)
    late = F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(P.LATE_SECONDS)).cast("decimal(18,6)"))
    arrivals = reliable_checkpoint(events.withColumn("arrived_at", F.col("event_time") + late))
    active = t.streamers.filter(F.col("is_active")).select("streamer_id", "username")
    SV.write_tracked(root, active if added_later is None else active.filter(~added_later), P.TRACKED_SINCE)

    def before(k):
        if k == 1 and added_later is not None:
            SV.write_tracked(root, active.filter(added_later), P.TRACKED_LATER)

    SV.replay(
        t.spark, arrivals, root, slices=3, before=before, minutes=P.TICK_MINUTES,
        watermark=f"{P.LATE_SECONDS + 1} seconds", max_session_hours=P.MAX_SESSION_HOURS,
    )
    return SV.records(t.spark, root), root


def s1_s2_stream_sessions(t):
    """S1/S2 streamed: sessions from the keyed state over several out-of-order
    micro-batches equal the batch twin (S3)."""
    return SS.session_table(_live(t)[0])


def _per_session(messages):
    return messages.groupBy("streamer_id", "started_at").agg(
        F.count(F.lit(1)).alias("messages"), F.min("event_time").alias("first_message"), F.max("event_time").alias("last_message")
    )


def s4_stream_chat_per_session(t):
    """S4 streamed: messages attached by the keyed state as they pass."""
    return _per_session(SS.attached_messages(_live(t)[0]))


def s5_stream_carry_over(t):
    """S5 streamed: samples with the messages since the session's previous sample."""
    return SS.attached_samples(_live(t)[0]).select("poll_event_id", "streamer_id", "started_at", "chat_messages_delta")


def s6_stream_snapshots(t):
    """S6 streamed: snapshots put out when the watermark passes their tick."""
    return SS.snapshots(_live(t)[0]).drop("level", "session_seq")


def s13_stream_message_tail(t):
    """S13 streamed: messages after the last sample, put out when a session ends."""
    return SS.message_tails(_live(t)[0]).select("streamer_id", "started_at", "chat_messages_delta")


def s14_stream_counters(t):
    """The service's counters of every entity that sent anything, read from the
    state store by another session."""
    from vantage.streaming import service as SV

    _, root = _live(t)
    found = SV.counters(t.spark.newSession(), root)
    return found.filter(sum(F.col(c) for c in SS.COUNTERS) > 0)


def s10_stream_tracked_changes(t):
    """Messages per session when every second entity joins the tracked set while
    the service runs."""
    return _per_session(SS.attached_messages(_live(t, added_later=F.col("streamer_id") % 2 == 1)[0]))


def s5_stream_chat_ticks(t, minutes=P.TICK_MINUTES):
    """S5/S9/S10/S11 streamed chat counts per entity per tick; the newest update of a
    tick counts, so the tick still open at the end is there too."""
    chat = IG.filtered_chat(L.chat_events(_event_stream(t)), t.streamers.filter(F.col("is_active")))
    return IG.run_available_now(IG.tick_counts(chat, minutes), t.spark, keys=["streamer_id", "tick_end"])


def s6_stream_poll_ticks(t, minutes=P.TICK_MINUTES):
    """S6/S17 streamed last poll sample per entity per tick."""
    return IG.run_available_now(IG.poll_ticks(L.poll_samples(_event_stream(t)), minutes), t.spark, keys=["streamer_id", "tick_end"])


def s15_stream_poll_outcomes(t, minutes=P.TICK_MINUTES):
    return IG.run_available_now(IG.poll_outcome_ticks(L.poll_samples(_event_stream(t)), minutes), t.spark, keys=["tick_end"])


# ------------------------------------------------------------ lookups, counts


def a2_active_entities(t):
    return Lk.active_entities(t.streamers)


def a3_tracked_entities(t):
    return Lk.tracked_entities(t.streamers)


def a6_open_sessions(t):
    return Lk.open_sessions(t.broadcasts().select("broadcast_id", "streamer_id", "started_at", "ended_at"))


def a7_latest_open_session(t):
    return Lk.latest_open_session(t.broadcasts())


def a8_snapshot_count(t):
    return Lk.snapshot_count(t.snapshots)


def e37_table_counts(t):
    return Lk.table_counts(t.streamers, t.broadcasts(), t.snapshots)


def w2_upsert_entities(t, now=P.NOW):
    """Profiles seen in chat (login and display name of each channel) upserted
    into the active entities, whose display names an earlier import left in lower
    case; unseen ids are inserted, other columns keep their values."""
    seen = L.chat_events(t.events).join(t.events.select(F.col("event_id"), F.col("user_id").alias("streamer_id")), "event_id")
    incoming = seen.select("streamer_id", F.lower("channel").alias("username"), F.col("channel").alias("display_name")).distinct()
    target = _tracked(t).select("streamer_id", "username", F.col("username").alias("display_name"), "is_active").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return Wr.upsert_entities(target, incoming, now)


def w13_engagement_rate(t):
    return Wr.with_engagement_rate(t.snapshots.select("broadcast_id", "snapshot_timestamp", "concurrent_viewers", "chat_messages_delta"))


def p15_baseline_tiers(t):
    """Entities ranked by the model-free baseline score, with tier
    and recommended action (CASE chains, no row-wise Python)."""
    from vantage.functions.tiers import recommended_action, score_tier

    s = _baseline_scored(t).join(t.streamers.select("streamer_id", "username"), "streamer_id")
    return s.select(
        "username", "score", score_tier("score").alias("tier"), recommended_action("score").alias("recommended_action")
    ).orderBy(F.col("score").desc(), "username")


def p8_sparse_keys(t, as_of=P.AS_OF):
    """The keys of the rows that each of the named sparse predicates selects.  Peaks
    come from the session rollup, growth and consistency from the extended statistics;
    a trending category stands for one that the games database knows."""
    snaps, tasks = t.spread_snapshots()
    stats = _stats_on(t, as_of, snapshots=snaps).select("streamer_id", "avg_chat_rate", "follower_velocity", "unique_categories")
    extended = agg.extended_statistics(t.broadcasts(with_primary_category=True), snaps, as_of, P.WINDOW_DAYS)
    sessions = J.spread(t.broadcasts().select("broadcast_id", "ended_at"), tasks, "broadcast_id").join(
        agg.session_rollup(snaps).select("broadcast_id", "peak_viewers"), "broadcast_id", "left"
    )
    categories = t.categories.withColumn("igdb_id", F.when(F.col("is_trending"), F.col("category_id")))
    tables = [
        ("broadcasts", "broadcast_id", sessions, ["live_sessions", "has_peak"]),
        ("broadcast_snapshots", "broadcast_id", snaps, ["busy_chat"]),
        ("categories", "category_id", categories, ["trending", "has_type", "has_igdb"]),
        ("streamers", "streamer_id", t.streamers, ["active", "has_language"]),
        ("streamer_statistics", "streamer_id", stats, ["positive_chat_rate", "positive_velocity", "multi_category"]),
        ("streamer_statistics", "streamer_id", extended, ["positive_growth", "positive_consistency"]),
    ]
    out = None
    for table, key, df, names in tables:
        # A predicate belongs to one entry, so its rows are counted there, by the key that they are dealt by.
        counts = [F.count_if(F.expr(flt.SPARSE_PREDICATES[n])).alias(n) for n in names]
        per_key = df.groupBy(F.col(key).cast("bigint").alias("id")).agg(*counts)
        hit = F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(n).alias("row_count")) for n in names]))
        rows = per_key.select("id", hit.alias("hit")).where("hit.row_count > 0")
        rows = rows.select("hit.predicate", F.lit(table).alias("table_name"), "id", "hit.row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


def p8_sparse_predicates(t, as_of=P.AS_OF):
    """P8 how many rows each named sparse predicate selects, per table."""
    stats = _stats_on(t, as_of)
    parts = [
        ("live_sessions", "broadcasts", t.broadcasts()),
        ("busy_chat", "broadcast_snapshots", t.snapshots),
        ("trending", "categories", t.categories),
        ("has_type", "categories", t.categories),
        ("active", "streamers", t.streamers),
        ("has_language", "streamers", t.streamers),
        ("positive_chat_rate", "streamer_statistics", stats),
        ("positive_velocity", "streamer_statistics", stats),
        ("multi_category", "streamer_statistics", stats),
    ]
    out = None
    for name, table, df in parts:
        c = flt.sparse_filter(df, name).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("predicate"), F.lit(table).alias("table_name"), "row_count"
        )
        out = c if out is None else out.unionByName(c)
    return out


def w5_close_sessions(t, now=P.NOW):
    """Each offline event closes the newest session of its entity still open;
    returns the sessions that closed."""
    off = L.lifecycle_events(t.events).filter(F.col("kind") == "offline").select("streamer_id", "event_time")
    b = t.broadcasts().select("broadcast_id", "streamer_id", "started_at", "ended_at", "duration_seconds")
    closed = Wr.close_sessions(b, off, None)
    was_open = b.filter(F.col("ended_at").isNull()).select("broadcast_id")
    return closed.join(was_open, "broadcast_id", "left_semi").filter(F.col("ended_at").isNotNull())


def d3_tracked_union(t):
    """D3: the tracked set after adding every channel seen in chat."""
    tracked = t.streamers.filter(F.col("is_active")).select("username")
    added = L.chat_events(t.events).select(F.col("channel").alias("username"))
    return Lk.tracked_union(tracked, added)


def d4_tracked_difference(t, now=P.NOW, days=P.INACTIVE_DAYS):
    """The tracked set without the entities inactive for ``days`` days."""
    tracked = t.streamers.filter(F.col("is_active")).select("username")
    return Lk.tracked_difference(tracked, _inactive_entities(t, now, days).select("username"))


def a4_entity_by_id(t, streamer_id=P.LOOKUP_ID):
    return Lk.entity_by_id(t.streamers.select("streamer_id", "username", "display_name"), streamer_id)


def a5_entity_by_username(t, username=P.LOOKUP_NAME):
    return Lk.entity_by_username(t.streamers, username)


def d2_names_not_found(t):
    """Requested names (channels of the chat, duplicates kept, and names
    outside the directory) that no entity has."""
    requested = L.chat_events(t.events).select(F.col("channel").alias("username"))
    requested = requested.unionByName(t.raw("supplier").select(F.col("s_name").alias("username")))
    return J.not_found(requested, t.streamers)


def p6_declared_names(t, as_of=P.AS_OF):
    """Statistics under their declared column names, read back under the
    writer's names and declared again."""
    declared = Lk.rename_stats(q8_rolling_stats(t, as_of), to="ddl")
    return Lk.rename_stats(Lk.rename_stats(declared), to="ddl")


def p18_ratio_bands(t):
    """Entities per band of the tune-in ratio."""
    from vantage.functions.tiers import ratio_band

    return _training(t).groupBy(ratio_band("tune_in_ratio").alias("band")).agg(F.count(F.lit(1)).alias("entities"))


def w6_session_defaults(t):
    """Open sessions get a zero duration, everything else keeps its value."""
    b = t.broadcasts().select("broadcast_id", "duration_seconds")
    return Wr.apply_defaults(b, {"duration_seconds": F.lit(0)})


def s12_six_hour_ticks(t, minutes=360):
    """Snapshots on six-hour ticks."""
    return s6_snapshot_ticks(t, minutes)


def s13_message_tail(t):
    """Messages of each session after its last sample."""
    chat, polls = _attached(t)
    tail = LC.chat_delta_carry_over(chat, polls, keep_tail=True).filter(F.col("poll_event_id").isNull())
    return tail.join(_sessions(t).select("broadcast_id", "streamer_id", "started_at"), "broadcast_id").select(
        "streamer_id", "started_at", "chat_messages_delta"
    )
