"""Oracle SQL per registered query (DuckDB dialect, same parameters)."""

from __future__ import annotations

import datetime as dt

from vantage.plans import params as P
from vantage.plans.oracle import with_views


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s[:10])


def _ts(d) -> str:
    if isinstance(d, dt.datetime):
        return f"TIMESTAMP '{d.isoformat(sep=' ')}'"
    return f"TIMESTAMP '{d.isoformat()} 00:00:00'"


def _stats_ctes(grid_sql: str, window_days: int, p: str = "h") -> str:
    """CTEs ending in ``{p}_stats``: rolling statistics for every date of ``grid_sql``
    (a query returning ``calculation_date``), rounded to the stored scale."""
    return f"""
{p}_grid AS ({grid_sql}),
{p}_rb AS (
    SELECT g.calculation_date, b.streamer_id,
           date_diff('microsecond', b.started_at, b.ended_at) / 1e6 / 3600.0 AS duration_hours
    FROM broadcasts b JOIN {p}_grid g
      ON b.started_at >= g.calculation_date - INTERVAL {window_days} DAY
     AND b.started_at < g.calculation_date + INTERVAL 1 DAY
    WHERE b.ended_at IS NOT NULL
),
{p}_bm AS (
    SELECT streamer_id, calculation_date, count(*) AS total_broadcasts,
           sum(duration_hours) AS total_broadcast_hours, avg(duration_hours) AS avg_broadcast_duration
    FROM {p}_rb GROUP BY streamer_id, calculation_date
),
{p}_rs AS (
    SELECT g.calculation_date, bs.*
    FROM broadcast_snapshots bs JOIN {p}_grid g
      ON bs.snapshot_timestamp >= g.calculation_date - INTERVAL {window_days} DAY
     AND bs.snapshot_timestamp < g.calculation_date + INTERVAL 1 DAY
),
{p}_sm AS (
    SELECT streamer_id, calculation_date,
           avg(concurrent_viewers) AS avg_concurrent_viewers,
           max(concurrent_viewers) AS max_concurrent_viewers,
           quantile_cont(concurrent_viewers, 0.5) AS median_concurrent_viewers,
           CAST(sum(chat_messages_delta) AS DOUBLE) / NULLIF(sum(concurrent_viewers) * 0.25, 0) AS avg_chat_rate,
           count(DISTINCT category_id) AS unique_categories,
           max(follower_count) - min(follower_count) AS follower_gain_30d,
           max(follower_count) AS latest_follower_count
    FROM {p}_rs GROUP BY streamer_id, calculation_date
),
{p}_j AS (
    SELECT s.streamer_id, bm.calculation_date, bm.total_broadcasts, bm.total_broadcast_hours, bm.avg_broadcast_duration,
           coalesce(sm.avg_concurrent_viewers, 0) AS avg_concurrent_viewers,
           coalesce(sm.max_concurrent_viewers, 0) AS max_concurrent_viewers,
           coalesce(sm.median_concurrent_viewers, 0) AS median_concurrent_viewers,
           coalesce(sm.avg_chat_rate, 0) AS avg_chat_rate,
           coalesce(sm.unique_categories, 0) AS unique_categories,
           coalesce(sm.follower_gain_30d, 0) AS follower_gain_30d,
           coalesce(sm.latest_follower_count, 0) AS latest_follower_count
    FROM streamers s JOIN {p}_bm bm ON bm.streamer_id = s.streamer_id
    LEFT JOIN {p}_sm sm ON sm.streamer_id = s.streamer_id AND sm.calculation_date = bm.calculation_date
    WHERE s.is_active AND bm.total_broadcasts > 0
),
{p}_stats AS (
    SELECT streamer_id,
           CAST(calculation_date AS DATE) AS calculation_date,
           CAST(total_broadcasts AS BIGINT) AS total_broadcasts,
           round(CAST(total_broadcast_hours AS DOUBLE), 2) AS total_broadcast_hours,
           round(CAST(avg_broadcast_duration AS DOUBLE), 2) AS avg_broadcast_duration,
           round(CAST(avg_concurrent_viewers AS DOUBLE), 2) AS avg_concurrent_viewers,
           CAST(max_concurrent_viewers AS INTEGER) AS max_concurrent_viewers,
           round(CAST(median_concurrent_viewers AS DOUBLE), 2) AS median_concurrent_viewers,
           round(CAST(avg_chat_rate AS DOUBLE), 4) AS avg_chat_rate,
           CAST(unique_categories AS BIGINT) AS unique_categories,
           CAST(follower_gain_30d AS BIGINT) AS follower_gain_30d,
           CAST(latest_follower_count AS BIGINT) AS latest_follower_count,
           round(CASE WHEN follower_gain_30d <> 0 AND total_broadcast_hours > 0
                      THEN follower_gain_30d / total_broadcast_hours ELSE 0 END, 2) AS follower_velocity
    FROM {p}_j
)"""


def _one_date(as_of: str) -> str:
    return f"SELECT DATE '{_d(as_of).isoformat()}' AS calculation_date"


def _grid(dates=P.STATS_DATES) -> str:
    first, last, step = dates
    return (
        f"SELECT CAST(d AS DATE) AS calculation_date "
        f"FROM generate_series(DATE '{first}', DATE '{last}', INTERVAL {step} DAY) AS t(d)"
    )


def q8_rolling_stats(as_of: str = P.AS_OF, window_days: int = P.WINDOW_DAYS) -> str:
    return with_views("SELECT * FROM d_stats", _stats_ctes(_one_date(as_of), window_days, "d"))


def v8_stats_history(dates=P.STATS_DATES, window_days: int = P.WINDOW_DAYS) -> str:
    return with_views("SELECT * FROM h_stats", _stats_ctes(_grid(dates), window_days, "h"))


def q9_daily_stats_ddl(as_of=P.AS_OF, days=P.RECENT_DAYS) -> str:
    # a session without snapshots still counts once
    ctes = f"""
t AS ({_totals()}),
x AS (
    SELECT streamer_id, count(*) AS k, {MEAN_E} AS e, {SPEED.replace("n *", "coalesce(n, 1) *")} AS speed
    FROM broadcasts LEFT JOIN t USING (broadcast_id)
    WHERE started_at > {_since(as_of, days)}
    GROUP BY streamer_id
)"""
    return with_views(f"""
SELECT streamer_id, DATE '{_d(as_of).isoformat()}' AS calculation_date, coalesce(k, 0) AS total_broadcasts,
       round(e / 0.25, 4) AS average_chat_rate, round(speed, 2) AS follower_velocity
FROM streamers LEFT JOIN x USING (streamer_id)""", ctes)


def _training_ctes(dates=P.STATS_DATES, window_days=P.WINDOW_DAYS, label_threshold=P.LABEL_THRESHOLD, min_hours=P.MIN_HOURS) -> str:
    return _stats_ctes(_grid(dates), window_days, "h") + f""",
ends AS (
    SELECT streamer_id, min(calculation_date) AS calculation_date, max(avg_concurrent_viewers) AS best
    FROM h_stats GROUP BY streamer_id
),
training AS (
    SELECT streamer_id, total_broadcasts, h.total_broadcast_hours * 1.0::DOUBLE AS total_broadcast_hours,
           avg_concurrent_viewers::DOUBLE AS first_30d_avg_viewers, avg_chat_rate::DOUBLE AS first_30d_chat_rate,
           follower_gain_30d::DOUBLE AS first_30d_follower_gain, follower_velocity::DOUBLE AS first_30d_follower_velocity,
           unique_categories::DOUBLE AS first_30d_unique_categories, latest_follower_count::DOUBLE AS first_30d_follower_count,
           (best >= {label_threshold})::INTEGER AS is_mega_streamer,
           avg_concurrent_viewers::DOUBLE / (latest_follower_count::DOUBLE + 1e-6) AS tune_in_ratio
    FROM h_stats h JOIN ends USING (streamer_id, calculation_date)
    WHERE h.total_broadcast_hours > {min_hours}
)"""


def q10_training_set() -> str:
    return with_views("SELECT * FROM training ORDER BY streamer_id", _training_ctes())


def _best_by_chat_rate(columns: str, k: int, condition: str, as_of) -> str:
    """The k statistics rows of a date with the highest chat rate, by their place."""
    ctes = _stats_ctes(_one_date(as_of), P.WINDOW_DAYS, "d") + f""",
placed AS (
    SELECT d_stats.*, login, row_number() OVER (ORDER BY avg_chat_rate IS NOT NULL, -avg_chat_rate, login) AS place
    FROM d_stats JOIN (SELECT streamer_id, username AS login FROM streamers) USING (streamer_id)
    WHERE {condition}
)"""
    return with_views(f"SELECT login AS username, {columns} FROM placed WHERE place <= {k}", ctes)


def q11_top_chat_rate(as_of=P.AS_OF, k=10) -> str:
    return _best_by_chat_rate("avg_chat_rate, avg_concurrent_viewers, total_broadcasts", k, "true", as_of)


def q12_growth_history(dates=P.STATS_DATES, window_days=P.WINDOW_DAYS, n=30) -> str:
    return with_views(f"""
SELECT streamer_id, calculation_date, follower_gain_30d, follower_velocity, total_broadcast_hours
FROM (SELECT *, row_number() OVER (PARTITION BY streamer_id ORDER BY calculation_date DESC) AS rn FROM h_stats)
WHERE rn <= {n}""", _stats_ctes(_grid(dates), window_days, "h"))


def q13_hidden_gems(as_of=P.AS_OF, k=20) -> str:
    """Small audiences that chat much and grow fast (fixed cut points)."""
    small, chatty, growing = "avg_concurrent_viewers < 500", "avg_chat_rate > 5", "follower_velocity > 2"
    wanted = "avg_chat_rate, avg_concurrent_viewers, follower_velocity, unique_categories"
    return _best_by_chat_rate(wanted, k, f"{small} AND {chatty} AND {growing}", as_of)


def q14_multi_category_gems(now=P.AS_OF, days=P.MULTI_CAT_DAYS, k=10) -> str:
    """From per-session totals: sessions bring their category, snapshots their sums."""
    ctes = f"""
recent AS (SELECT broadcast_id, streamer_id, primary_category_id AS cat FROM broadcasts WHERE started_at > {_since(now, days)}),
per_session AS ({_totals()}),
per_entity AS (
    SELECT streamer_id, count(DISTINCT cat) AS cats, sum(se) / sum(ne) AS eng, sum(v) * 1.0 / sum(n) AS viewers
    FROM recent JOIN per_session USING (broadcast_id) GROUP BY streamer_id
),
placed AS (
    SELECT username, cats, round(eng, 3) AS eng, round(viewers, 0) AS viewers,
           row_number() OVER (ORDER BY round(eng, 3) DESC, username) AS place
    FROM per_entity JOIN streamers USING (streamer_id) WHERE cats > 2 AND eng > 5
)"""
    return with_views(f"SELECT username, cats AS categories_count, eng AS avg_engagement, viewers AS avg_viewers FROM placed WHERE place <= {k}", ctes)


def _since(as_of: str, days: int) -> str:
    return _ts(_d(as_of) - dt.timedelta(days=days))


def _totals(keys: str = "broadcast_id") -> str:
    """Snapshot rows summed by ``keys``: rows n, viewers v, and count, sum and sum of
    squares of the messages per viewer (ne, se, qe)."""
    return f"""
    SELECT {keys}, count(*) AS n, sum(concurrent_viewers) AS v, count(e) AS ne, sum(e) AS se, sum(e * e) AS qe
    FROM (SELECT *, chat_messages_delta * 1.0 / NULLIF(concurrent_viewers, 0) AS e FROM broadcast_snapshots)
    GROUP BY {keys}"""


MEAN_E, MEAN_V = "sum(se) / NULLIF(sum(ne), 0)", "sum(v) / sum(n)"
# sample deviation from the summed squares
SPREAD_E = "sqrt(greatest(sum(qe) - sum(se) * sum(se) / NULLIF(sum(ne), 0), 0) / NULLIF(sum(ne) - 1, 0))"
GAIN = "sum(n * follower_gain)"
HOURS = "sum(n * duration_seconds) / 3600.0"
SPEED = f"CAST({GAIN} AS DOUBLE) / NULLIF({HOURS}, 0)"


def _by_entity(measures: str, since: str | None = None) -> str:
    """CTE ``x``: ``measures`` over the sessions of each entity and their totals."""
    return f"""
t AS ({_totals()}),
x AS (
    SELECT streamer_id, {measures}
    FROM broadcasts JOIN t USING (broadcast_id) {f"WHERE started_at > {since}" if since else ""}
    GROUP BY streamer_id
)"""


def q1_high_engagement(as_of=P.AS_OF, days=P.RECENT_DAYS) -> str:
    measures = f"""count(*) AS total_broadcasts, count(DISTINCT primary_category_id) AS categories_played,
           {MEAN_E} AS e, {SPREAD_E} AS spread, {MEAN_V} AS v"""
    return with_views("""
SELECT username, display_name, total_broadcasts, categories_played, round(e, 3) AS avg_engagement_rate,
       round(spread, 3) AS engagement_consistency, round(v, 0) AS avg_viewers
FROM x JOIN streamers USING (streamer_id)
WHERE e > 5.0
ORDER BY 5 DESC NULLS FIRST, username""", _by_entity(measures, _since(as_of, days)))


def q2_category_independent(as_of=P.AS_OF, days=P.RECENT_DAYS_Q2) -> str:
    ctes = f"""
t AS ({_totals("broadcast_id, category_id")}),
per_name AS (
    SELECT streamer_id, category_name, {MEAN_E} AS e
    FROM t JOIN broadcasts USING (broadcast_id) JOIN categories USING (category_id)
    WHERE started_at > {_since(as_of, days)}
    GROUP BY streamer_id, category_name
    HAVING count(DISTINCT broadcast_id) >= 2
),
x AS (
    SELECT streamer_id, count(*) AS k, avg(e) AS mean, stddev_samp(e) AS spread, min(e) AS low, max(e) AS high
    FROM per_name GROUP BY streamer_id
)"""
    return with_views("""
SELECT username, k AS categories_count, round(mean, 3) AS overall_avg_engagement, round(spread, 3) AS engagement_variance,
       round(low, 3) AS min_category_engagement, round(high, 3) AS max_category_engagement,
       CASE WHEN spread < 0.5 THEN 'HIGHLY VERSATILE' WHEN spread < 1.0 THEN 'VERSATILE' ELSE 'GAME-DEPENDENT' END
         AS versatility_rating
FROM x JOIN streamers USING (streamer_id)
WHERE k >= 2
ORDER BY 4 ASC NULLS LAST, 3 DESC NULLS FIRST, username""", ctes)


def q3_hype_dependency() -> str:
    ctes = f"""
t AS ({_totals("broadcast_id, category_id")}),
x AS (
    SELECT streamer_id, category_id, CAST(sum(n) AS BIGINT) AS k, {MEAN_V} AS v, {MEAN_E} AS e, {GAIN} AS gain
    FROM t JOIN broadcasts USING (broadcast_id) GROUP BY streamer_id, category_id
)"""
    return with_views("""
SELECT username, category_name, is_trending, k AS broadcasts_count, round(v, 0) AS avg_viewers,
       round(e, 3) AS engagement_rate, CAST(gain AS BIGINT) AS total_followers_gained
FROM x JOIN streamers USING (streamer_id) JOIN categories USING (category_id)
ORDER BY username, is_trending DESC NULLS FIRST, 5 DESC NULLS FIRST, category_name""", ctes)


def q4_follower_velocity(as_of=P.AS_OF, days=P.RECENT_DAYS) -> str:
    measures = f"CAST({GAIN} AS BIGINT) AS gain, {HOURS} AS hours, {SPEED} AS speed, {MEAN_V} AS v"
    return with_views("""
SELECT username, gain AS total_follower_gain, round(hours, 1) AS total_hours_streamed, round(speed, 2) AS follower_velocity,
       round(v, 0) AS avg_viewers, round(speed / NULLIF(v, 0) * 100, 3) AS efficiency_score
FROM x JOIN streamers USING (streamer_id)
ORDER BY 4 DESC NULLS FIRST, username""", _by_entity(measures, _since(as_of, days)))


def q5_hidden_gem_score(as_of=P.AS_OF, days=P.RECENT_DAYS, k=10) -> str:
    measures = f"""{MEAN_E} AS e, {SPREAD_E} AS spread, {SPEED} AS speed,
           count(DISTINCT primary_category_id) AS kinds, {MEAN_V} AS v"""
    # fixed values: the weights and cut points of the score
    bonus = "20 * CAST(coalesce(spread < 1, false) AS INTEGER) + CASE WHEN v < 200 THEN 30 WHEN v > 1000 THEN -50 ELSE 0 END"
    return with_views(f"""
SELECT username, display_name, round(e, 3) AS engagement_rate, round(spread, 3) AS engagement_consistency,
       round(speed, 2) AS follower_velocity, kinds AS unique_categories, round(v, 0) AS avg_viewers,
       round(20 * e + 10 * speed + 15 * kinds + {bonus}, 2) AS hidden_gem_score
FROM x JOIN streamers USING (streamer_id)
ORDER BY 8 DESC NULLS FIRST, username
LIMIT {k}""", _by_entity(measures, _since(as_of, days)))


SNAP_ORDER = "bs.snapshot_timestamp, bs.category_id, bs.concurrent_viewers, bs.chat_messages_delta, bs.follower_count"


def q6_retention_curve() -> str:
    """Neighbours by number within the session; hours and messages per viewer as ratios."""
    order = SNAP_ORDER.replace("bs.", "")
    ctes = f"""
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY {order}) AS k FROM broadcast_snapshots
),
before AS (SELECT broadcast_id, k + 1 AS k, follower_count AS had FROM numbered)"""
    return with_views("""
SELECT broadcast_id, snapshot_timestamp, concurrent_viewers, chat_messages_delta, follower_count,
       follower_count - had AS follower_gain_delta, round(stream_uptime_seconds / 3600.0, 2) AS hours_into_stream,
       CASE WHEN concurrent_viewers <> 0 THEN round(chat_messages_delta * 1.0::DOUBLE / concurrent_viewers, 3) END AS engagement_rate
FROM numbered LEFT JOIN before USING (broadcast_id, k)""", ctes)


def q7_category_switch_impact() -> str:
    order = SNAP_ORDER.replace("bs.", "")
    ctes = f"""
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY broadcast_id ORDER BY {order}) AS k FROM broadcast_snapshots
)"""
    return with_views("""
SELECT now.streamer_id, username, old.category_name AS from_category, new.category_name AS to_category,
       was.concurrent_viewers AS viewers_before_switch, now.concurrent_viewers AS viewers_after_switch,
       now.concurrent_viewers - was.concurrent_viewers AS viewer_change,
       round(CAST(now.concurrent_viewers - was.concurrent_viewers AS DOUBLE) / NULLIF(was.concurrent_viewers, 0) * 100, 1)
         AS percent_change
FROM numbered now JOIN numbered was ON was.broadcast_id = now.broadcast_id AND was.k = now.k - 1
JOIN streamers USING (streamer_id)
JOIN categories old ON old.category_id = was.category_id
JOIN categories new ON new.category_id = now.category_id
WHERE now.category_id <> was.category_id
ORDER BY 7 DESC NULLS FIRST""".replace("JOIN streamers USING (streamer_id)", "JOIN streamers ON streamers.streamer_id = now.streamer_id"), ctes)


def q18_quick_counts() -> str:
    return with_views("""
SELECT username, k AS broadcast_count, round(v, 0) AS avg_viewers
FROM x JOIN streamers USING (streamer_id)
ORDER BY 3 DESC NULLS FIRST, username""", _by_entity(f"CAST(sum(n) AS BIGINT) AS k, {MEAN_V} AS v"))


# ---------------------------------------------- discovery, freshness, bulk add

EVENT_VIEWS = """
listing AS (
    SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS game_id,
           user_id,
           lower('Customer#' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0')) AS user_login,
           CAST(floor(value) AS INTEGER) AS viewer_count,
           ts, event_id
    FROM events WHERE event_type = 'purchase'
),
chat AS (
    SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS channel,
           (event_type = 'view' AND value < 5) AS is_echo,
           ts AS event_time, event_id
    FROM events WHERE event_type IN ('click', 'view')
)"""


def _now(now: str) -> dt.datetime:
    return dt.datetime.fromisoformat(now)


def q15_discoveries_per_day() -> str:
    return with_views("""
SELECT CAST(discovered_at AS DATE) AS discovery_date, COUNT(*) AS streamers_added
FROM streamers GROUP BY CAST(discovered_at AS DATE) ORDER BY discovery_date DESC""")


def q16_recent_account_age(now=P.NOW, days=P.DISCOVERY_RECENT_DAYS) -> str:
    n = _now(now)
    return with_views(f"""
SELECT COUNT(*) AS total,
       CAST(round(AVG(date_diff('microsecond', account_created_at, {_ts(n)}) / 86400e6), 0) AS INTEGER) AS avg_account_age_days
FROM streamers
WHERE discovered_at > {_ts(n - dt.timedelta(days=days))}""")


def q17_recent_active(k=10) -> str:
    return with_views(f"""
SELECT streamer_id, username, display_name, discovered_at, is_active
FROM streamers WHERE is_active
ORDER BY discovered_at DESC NULLS FIRST, streamer_id
LIMIT {k}""")


def q19_snapshot_freshness(now=P.NOW, seconds=P.FRESHNESS_SECONDS) -> str:
    n = _now(now)
    return with_views(f"""
SELECT COUNT(*) AS snapshots_recent, MAX(snapshot_timestamp) AS latest_snapshot
FROM broadcast_snapshots
WHERE snapshot_timestamp > {_ts(n - dt.timedelta(seconds=seconds))}""")


def e19_stats_freshness(dates=P.STATS_DATES, expected=P.AS_OF) -> str:
    return with_views(f"""
SELECT MAX(calculation_date) AS latest_calculation_date,
       DATE '{expected}' AS expected_date,
       MAX(calculation_date) >= DATE '{expected}' AS up_to_date
FROM h_stats""", _stats_ctes(_grid(dates), P.WINDOW_DAYS, "h"))


def q20_discovery_candidates(lo=P.MIN_LISTING_VIEWERS, hi=P.MAX_LISTING_VIEWERS, limit=P.DISCOVERY_LIMIT) -> str:
    ctes = EVENT_VIEWS + f""",
elig AS (
    SELECT l.*, s.display_name,
           row_number() OVER (PARTITION BY l.game_id ORDER BY l.ts, l.event_id) AS rn
    FROM listing l JOIN streamers s ON s.streamer_id = l.user_id
    WHERE l.viewer_count BETWEEN {lo} AND {hi}
)"""
    return with_views(f"""
SELECT game_id, user_id, user_login, display_name, viewer_count, ts AS listed_at, event_id AS listing_event_id
FROM elig WHERE rn <= {limit}""", ctes)


def q20_discovery_summary(lo=P.MIN_LISTING_VIEWERS, hi=P.MAX_LISTING_VIEWERS, limit=P.DISCOVERY_LIMIT) -> str:
    ctes = EVENT_VIEWS + f""",
flagged AS (
    SELECT l.*,
           (l.viewer_count BETWEEN {lo} AND {hi}) AND t.streamer_id IS NULL AND p.streamer_id IS NOT NULL AS eligible,
           (l.viewer_count BETWEEN {lo} AND {hi}) AND t.streamer_id IS NOT NULL AS skipped
    FROM listing l
    LEFT JOIN streamers t ON t.streamer_id = l.user_id AND t.is_active
    LEFT JOIN streamers p ON p.streamer_id = l.user_id
),
numbered AS (
    SELECT *, SUM(CASE WHEN eligible THEN 1 ELSE 0 END)
                  OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS adds_so_far,
              SUM(CASE WHEN eligible THEN 1 ELSE 0 END)
                  OVER (PARTITION BY game_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS adds_before
    FROM flagged
)"""
    return with_views(f"""
SELECT game_id,
       COUNT(*) AS processed,
       COUNT(*) FILTER (WHERE skipped) AS skipped,
       CAST(MAX(adds_so_far) AS BIGINT) AS added
FROM numbered
WHERE coalesce(adds_before, 0) < {limit}
GROUP BY game_id""", ctes)


def _bulk_add_ctes() -> str:
    return EVENT_VIEWS + """,
requested AS (SELECT channel AS requested_username FROM chat UNION SELECT s_name FROM supplier),
outcomes AS (
    SELECT r.requested_username, s.streamer_id,
           CASE WHEN s.streamer_id IS NULL THEN 'not_found'
                WHEN e.streamer_id IS NOT NULL THEN 'skipped' ELSE 'added' END AS outcome
    FROM requested r
    LEFT JOIN streamers s ON lower(r.requested_username) = lower(s.username)
    LEFT JOIN streamers e ON e.streamer_id = s.streamer_id AND e.is_active
)"""


def q21_bulk_add() -> str:
    return with_views("SELECT requested_username, streamer_id, outcome FROM outcomes", _bulk_add_ctes())


def q21_bulk_add_summary() -> str:
    return with_views("""
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE outcome = 'added') AS added,
       COUNT(*) FILTER (WHERE outcome = 'skipped') AS skipped,
       COUNT(*) FILTER (WHERE outcome = 'failed') AS failed,
       COUNT(*) FILTER (WHERE outcome = 'not_found') AS not_found
FROM outcomes""", _bulk_add_ctes())


# ------------------------------------------------------ writes, data quality


def w1_replay_insert_ignore(as_of=P.AS_OF, replay_days=P.REPLAY_DAYS) -> str:
    d = _d(as_of)
    return with_views(f"""
SELECT broadcast_id, streamer_id, category_id, snapshot_timestamp, concurrent_viewers, follower_count,
       chat_messages_delta, stream_uptime_seconds
FROM (
    SELECT i.*, row_number() OVER (
        PARTITION BY broadcast_id, snapshot_timestamp
        ORDER BY streamer_id NULLS FIRST, category_id NULLS FIRST, concurrent_viewers NULLS FIRST,
                 follower_count NULLS FIRST, chat_messages_delta NULLS FIRST, stream_uptime_seconds NULLS FIRST) AS rn
    FROM broadcast_snapshots i
    WHERE snapshot_timestamp >= {_ts(d - dt.timedelta(days=replay_days))}
) f
WHERE rn = 1 AND NOT EXISTS (
    SELECT 1 FROM broadcast_snapshots t
    WHERE t.snapshot_timestamp < {_ts(d)}
      AND t.broadcast_id = f.broadcast_id AND t.snapshot_timestamp = f.snapshot_timestamp)""")


def w3_upsert_stats(dates=P.STATS_DATES, as_of=P.AS_OF, now=P.NOW) -> str:
    ctes = _stats_ctes(_grid(dates), P.WINDOW_DAYS, "h") + ",\n" + _stats_ctes(_one_date(as_of), 30, "d").strip()
    cols = ["total_broadcasts", "total_broadcast_hours", "avg_broadcast_duration", "avg_concurrent_viewers",
            "max_concurrent_viewers", "median_concurrent_viewers", "avg_chat_rate", "unique_categories",
            "follower_gain_30d", "latest_follower_count", "follower_velocity"]
    pick = ",\n       ".join(f"CASE WHEN d.streamer_id IS NOT NULL THEN d.{c} ELSE h.{c} END AS {c}" for c in cols)
    return with_views(f"""
SELECT coalesce(h.streamer_id, d.streamer_id) AS streamer_id,
       coalesce(h.calculation_date, d.calculation_date) AS calculation_date,
       {pick},
       CASE WHEN d.streamer_id IS NOT NULL THEN {_ts(_now(now))} END AS updated_at,
       CASE WHEN h.streamer_id IS NULL THEN {_ts(_now(now))} ELSE CAST(h.calculation_date AS TIMESTAMP) END AS created_at,
       CASE WHEN h.streamer_id IS NULL THEN {_ts(_now(now))} ELSE CAST(h.calculation_date AS TIMESTAMP) END AS calculated_at
FROM h_stats h FULL OUTER JOIN d_stats d
  ON h.streamer_id = d.streamer_id AND h.calculation_date = d.calculation_date""", ctes)


def w7_quarantine() -> str:
    return with_views("""
SELECT 'broadcasts' AS table_name, broadcast_id AS row_key, 'check_broadcast_times,check_duration_positive' AS failed
FROM broadcasts JOIN (SELECT broadcast_id, max(snapshot_timestamp) AS last FROM broadcast_snapshots GROUP BY broadcast_id)
  USING (broadcast_id)
WHERE last <= started_at
UNION ALL
SELECT 'broadcast_snapshots', broadcast_id, 'chat_messages_delta_non_negative'
FROM broadcast_snapshots WHERE chat_messages_delta < concurrent_viewers""")


def w8_duplicate_snapshot_keys() -> str:
    return with_views("""
SELECT broadcast_id, snapshot_timestamp, COUNT(*) AS occurrences
FROM broadcast_snapshots GROUP BY broadcast_id, snapshot_timestamp HAVING COUNT(*) > 1""")


def w8_entity_violations() -> str:
    return with_views("""
SELECT streamer_id,
       concat_ws(',', CASE WHEN streamer_id IS NULL THEN 'streamer_id is null' END,
                      CASE WHEN username IS NULL THEN 'username is null' END,
                      CASE WHEN length(username) > 25 THEN 'username longer than 25' END,
                      CASE WHEN length(display_name) > 25 THEN 'display_name longer than 25' END,
                      CASE WHEN length(broadcaster_language) > 9 THEN 'broadcaster_language longer than 9' END) AS violations
FROM streamers
WHERE streamer_id IS NULL OR username IS NULL OR length(username) > 25 OR length(display_name) > 25
   OR length(broadcaster_language) > 9""")


def w9_orphans() -> str:
    one = """
SELECT '{0}.{1}' AS foreign_key, {1} AS missing_id, count(*) AS orphans FROM {0}
WHERE {1} IS NOT NULL AND {1} NOT IN (SELECT {1} FROM {2}) GROUP BY {1}"""
    refs = [
        ("broadcast_snapshots", "broadcast_id", "broadcasts WHERE ended_at IS NOT NULL"),
        ("broadcast_snapshots", "streamer_id", "streamers WHERE is_active"),
        ("broadcast_snapshots", "category_id", "categories WHERE is_trending"),
        ("broadcasts", "streamer_id", "streamers WHERE is_active"),
    ]
    return with_views(" UNION ALL ".join(one.format(*r) for r in refs))


def w17_maintain_categories() -> str:
    return with_views("""
SELECT coalesce(c.category_id, s.category_id) AS category_id,
       coalesce(c.category_name, 'Unknown') AS category_name,
       c.category_type, c.is_trending,
       s.first_seen AS first_seen_at, s.last_seen AS last_seen_at
FROM (SELECT * FROM categories WHERE is_trending) c
FULL OUTER JOIN (SELECT category_id, MIN(snapshot_timestamp) AS first_seen, MAX(snapshot_timestamp) AS last_seen
                 FROM broadcast_snapshots WHERE category_id IS NOT NULL GROUP BY category_id) s
  ON s.category_id = c.category_id""")


def _inactive_cte(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    cut = _now(now) - dt.timedelta(days=days)
    return f"""
seen AS (SELECT streamer_id, MAX(snapshot_timestamp) AS last_seen_at FROM broadcast_snapshots GROUP BY streamer_id),
inactive AS (
    SELECT s.streamer_id, s.username, seen.last_seen_at
    FROM streamers s LEFT JOIN seen ON seen.streamer_id = s.streamer_id
    WHERE seen.last_seen_at IS NULL OR seen.last_seen_at < {_ts(cut)}
)"""


def w18_inactive_entities(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    return with_views("SELECT streamer_id, username, last_seen_at FROM inactive", _inactive_cte(now, days))


def w16_deactivate_inactive(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    return with_views("""
SELECT s.streamer_id, CASE WHEN i.streamer_id IS NOT NULL THEN false ELSE s.is_active END AS is_active
FROM streamers s LEFT JOIN inactive i ON i.streamer_id = s.streamer_id""", _inactive_cte(now, days))


def w10_delete_cascade(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    return with_views("""
SELECT 'streamers' AS table_name, COUNT(*) AS remaining_rows FROM streamers
 WHERE streamer_id NOT IN (SELECT streamer_id FROM inactive)
UNION ALL
SELECT 'broadcasts', COUNT(*) FROM broadcasts WHERE streamer_id NOT IN (SELECT streamer_id FROM inactive)
UNION ALL
SELECT 'broadcast_snapshots', COUNT(*) FROM broadcast_snapshots WHERE streamer_id NOT IN (SELECT streamer_id FROM inactive)""",
        _inactive_cte(now, days))


def _touched(parts: list[tuple[str, str, str, str]], ctes: str) -> str:
    """Keys by table and effect from (table, effect, id and place, source with condition)."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{e}' AS effect, {k} FROM {src}" for t, e, k, src in parts)
    return with_views(f"""
SELECT table_name, effect, id, place, count(*) AS row_count FROM ({rows}) AS r GROUP BY table_name, effect, id, place""", ctes)


_NO_PLACE = "CAST(NULL AS VARCHAR) AS place"
_SNAP_KEY = "broadcast_id AS id, strftime(snapshot_timestamp, '%Y-%m-%d %H:%M:%S') AS place"


def _extended(as_of=P.AS_OF) -> str:
    return f"xs AS MATERIALIZED (SELECT streamer_id, top_category_id FROM ({e21_e26_extended_stats(as_of)}) AS x)"


def w10_cascade_keys(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    gone = "streamer_id IN (SELECT streamer_id FROM inactive)"
    return _touched(
        [
            ("streamers", "deleted", f"streamer_id AS id, {_NO_PLACE}", f"streamers WHERE {gone}"),
            ("broadcasts", "deleted", f"broadcast_id AS id, {_NO_PLACE}", f"broadcasts WHERE {gone}"),
            ("broadcast_snapshots", "deleted", _SNAP_KEY,
             f"broadcast_snapshots WHERE {gone} OR broadcast_id IN (SELECT broadcast_id FROM broadcasts WHERE {gone})"),
            ("streamer_statistics", "deleted", f"streamer_id AS id, '{_d(P.AS_OF).isoformat()}' AS place", f"xs WHERE {gone}"),
        ],
        _inactive_cte(now, days) + "," + _extended(),
    )


def w11_nulled_keys(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    cut = _now(now) - dt.timedelta(days=days)
    ctes = f"""
cseen AS (SELECT category_id, MAX(snapshot_timestamp) AS last_seen_at FROM broadcast_snapshots GROUP BY category_id),
gone AS (
    SELECT c.category_id FROM categories c LEFT JOIN cseen ON cseen.category_id = c.category_id
    WHERE cseen.last_seen_at IS NULL OR cseen.last_seen_at < {_ts(cut)}
)"""
    hit = "IN (SELECT category_id FROM gone)"
    return _touched(
        [
            ("categories", "deleted", f"category_id AS id, {_NO_PLACE}", f"categories WHERE category_id {hit}"),
            ("broadcasts", "primary_category_id", f"broadcast_id AS id, {_NO_PLACE}", f"broadcasts WHERE primary_category_id {hit}"),
            ("broadcast_snapshots", "category_id", _SNAP_KEY, f"broadcast_snapshots WHERE category_id {hit}"),
            ("streamer_statistics", "top_category_id", f"streamer_id AS id, '{_d(P.AS_OF).isoformat()}' AS place", f"xs WHERE top_category_id {hit}"),
        ],
        ctes + "," + _extended(),
    )


def w11_delete_set_null(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    cut = _now(now) - dt.timedelta(days=days)
    return with_views(f"""
SELECT COUNT(*) AS snapshots,
       COUNT(*) FILTER (WHERE bs.category_id IS NULL OR bs.category_id IN (SELECT category_id FROM gone)) AS category_nulled
FROM broadcast_snapshots bs""", f"""
cseen AS (SELECT category_id, MAX(snapshot_timestamp) AS last_seen_at FROM broadcast_snapshots GROUP BY category_id),
gone AS (
    SELECT c.category_id FROM categories c LEFT JOIN cseen ON cseen.category_id = c.category_id
    WHERE cseen.last_seen_at IS NULL OR cseen.last_seen_at < {_ts(cut)}
)""")


def a19_archive_split(now=P.NOW, days=P.ARCHIVE_AFTER_DAYS) -> str:
    cut = _ts(_now(now) - dt.timedelta(days=days))
    return with_views(f"""
SELECT 'archive' AS part, COUNT(*) AS row_count FROM broadcast_snapshots WHERE snapshot_timestamp < {cut}
UNION ALL
SELECT 'live', COUNT(*) FROM broadcast_snapshots WHERE NOT coalesce(snapshot_timestamp < {cut}, false)""")


# ------------------------------------------------- ingestion (batch twins)

LIFECYCLE = """
lc AS (
    SELECT CASE WHEN event_type = 'signup' THEN 'online' ELSE 'offline' END AS kind,
           user_id AS streamer_id, ts AS event_time, event_id,
           CASE WHEN event_type = 'signup' THEN 'stream ' || CAST(event_id AS VARCHAR) END AS title,
           CASE WHEN event_type = 'signup' THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS category_id
    FROM events WHERE event_type IN ('signup', 'error')
),
lc1 AS (
    SELECT *, SUM(CASE WHEN kind = 'online' THEN 1 ELSE -1 END)
              OVER (PARTITION BY streamer_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM lc
),
lc2 AS (
    SELECT *, least(0, coalesce(MIN(s) OVER (PARTITION BY streamer_id ORDER BY event_time, event_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS p
    FROM lc1
),
lc3 AS (
    SELECT *, (kind = 'offline' AND s < p) AS unmatched,
           CAST(CASE WHEN kind = 'online' THEN s - least(p, s) ELSE s - least(p, s) + 1 END AS BIGINT) AS level
    FROM lc2
),
nx AS (
    SELECT *, LEAD(kind) OVER (PARTITION BY streamer_id, level ORDER BY event_time, event_id) AS next_kind,
              LEAD(event_time) OVER (PARTITION BY streamer_id, level ORDER BY event_time, event_id) AS next_time
    FROM lc3 WHERE NOT unmatched
),
sess AS (
    SELECT streamer_id, level,
           row_number() OVER (PARTITION BY streamer_id, level ORDER BY event_time, event_id) AS session_seq,
           event_time AS started_at,
           CASE WHEN next_kind = 'offline' THEN next_time END AS ended_at,
           CAST(round(date_diff('microsecond', event_time, CASE WHEN next_kind = 'offline' THEN next_time END) / 1e6, 0) AS INTEGER)
               AS duration_seconds,
           coalesce(nullif(title, ''), 'Untitled Stream') AS stream_title,
           category_id AS primary_category_id
    FROM nx WHERE kind = 'online'
)"""


def _attach(evs: str, name: str) -> str:
    """CTE ``{name}``: events of ``evs`` (streamer_id, event_time, event_id, ...)
    with the (streamer_id, started_at) of the session on top of the stack."""
    return f"""
{name}_m AS (
    SELECT streamer_id, event_time, event_id, kind, level,
           CASE WHEN unmatched THEN 0 WHEN kind = 'online' THEN 1 ELSE -1 END AS d
    FROM lc3
    UNION ALL
    SELECT streamer_id, event_time, event_id, 'event', NULL, 0 FROM {evs}
),
{name}_m2 AS (
    SELECT *, SUM(d) OVER (PARTITION BY streamer_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS depth
    FROM {name}_m
),
{name}_m3 AS (
    SELECT *, CASE WHEN kind = 'event' THEN depth ELSE level END AS lvl
    FROM {name}_m2 WHERE kind IN ('online', 'event')
),
{name}_m4 AS (
    SELECT *, SUM(CASE WHEN kind = 'online' THEN 1 ELSE 0 END)
              OVER (PARTITION BY streamer_id, lvl ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS k
    FROM {name}_m3 WHERE lvl > 0
),
{name} AS (
    SELECT e.*, s.started_at
    FROM {evs} e
    LEFT JOIN {name}_m4 m ON m.event_id = e.event_id AND m.kind = 'event'
    LEFT JOIN sess s ON s.streamer_id = m.streamer_id AND s.level = m.lvl AND s.session_seq = m.k
)"""


CHAT_POLL = """
chat_in AS (
    SELECT c.user_id AS streamer_id, c.ts AS event_time, c.event_id
    FROM events c JOIN streamers s ON lower('Customer#' || lpad(CAST(c.user_id AS VARCHAR), CAST(greatest(9, length(CAST(c.user_id AS VARCHAR))) AS INTEGER), '0')) = lower(s.username)
    WHERE c.event_type IN ('click', 'view') AND NOT (c.event_type = 'view' AND c.value < 5) AND s.is_active
),
poll_in AS (
    SELECT user_id AS streamer_id, ts AS event_time, event_id,
           CAST(floor(value) AS INTEGER) AS viewer_count,
           TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS category_id,
           CAST(floor(value * 100) AS BIGINT) AS follower_count
    FROM events WHERE event_type = 'purchase'
)"""


def s3_sessionize() -> str:
    return with_views("SELECT * FROM sess", LIFECYCLE)


def s2_dropped_offline() -> str:
    return with_views("SELECT streamer_id, COUNT(*) AS dropped_offline FROM lc3 WHERE unmatched GROUP BY streamer_id", LIFECYCLE)


def s8_orphan_sessions() -> str:
    return with_views("""
SELECT s.streamer_id, s.level, s.session_seq, s.started_at
FROM sess s JOIN (SELECT streamer_id, MAX(started_at) AS latest FROM sess GROUP BY streamer_id) l
  ON l.streamer_id = s.streamer_id
WHERE s.ended_at IS NULL AND s.started_at < l.latest""", LIFECYCLE)


def s4_chat_per_session() -> str:
    return with_views("""
SELECT streamer_id, started_at, COUNT(*) AS messages, MIN(event_time) AS first_message, MAX(event_time) AS last_message
FROM chat_att WHERE started_at IS NOT NULL GROUP BY streamer_id, started_at""",
        LIFECYCLE + "," + CHAT_POLL + "," + _attach("chat_in", "chat_att"))


def s5_chat_delta_carry_over() -> str:
    ctes = LIFECYCLE + "," + CHAT_POLL + "," + _attach("chat_in", "chat_att") + "," + _attach("poll_in", "poll_att") + """,
u AS (
    SELECT streamer_id, started_at, event_time, event_id, 0 AS is_poll, 1 AS o FROM chat_att WHERE started_at IS NOT NULL
    UNION ALL
    SELECT streamer_id, started_at, event_time, event_id, 1, 0 FROM poll_att WHERE started_at IS NOT NULL
),
r AS (
    SELECT *, SUM(is_poll) OVER (PARTITION BY streamer_id, started_at ORDER BY event_time, o, event_id ROWS UNBOUNDED PRECEDING) AS polls
    FROM u
),
msgs AS (SELECT streamer_id, started_at, polls + 1 AS slot, COUNT(*) AS n FROM r WHERE is_poll = 0 GROUP BY ALL)"""
    return with_views("""
SELECT p.event_id AS poll_event_id, p.streamer_id, p.started_at, CAST(coalesce(m.n, 0) AS BIGINT) AS chat_messages_delta
FROM r p LEFT JOIN msgs m ON m.streamer_id = p.streamer_id AND m.started_at = p.started_at AND m.slot = p.polls
WHERE p.is_poll = 1""", ctes)


def s6_snapshot_ticks(minutes=P.TICK_MINUTES) -> str:
    """A message counts in the session's first valid sample at or after it (a sample
    at the same instant reads the counter first); a tick sums its samples."""
    ctes = LIFECYCLE + "," + CHAT_POLL + "," + _attach("chat_in", "chat_att") + "," + _attach("poll_in", "poll_att") + f""",
valid AS (
    SELECT *, lead(event_time) OVER w AS later, lag(event_time) OVER w AS earlier, row_number() OVER w AS k
    FROM poll_att WHERE started_at IS NOT NULL AND viewer_count IS NOT NULL
    WINDOW w AS (PARTITION BY streamer_id, started_at ORDER BY event_time, event_id)
),
counted AS (
    SELECT v.event_id, count(c.event_id) AS n
    FROM valid v JOIN chat_att c ON c.streamer_id = v.streamer_id AND c.started_at = v.started_at
     AND c.event_time < v.event_time AND (v.earlier IS NULL OR c.event_time >= v.earlier)
    GROUP BY v.event_id
),
ticks AS (
    SELECT streamer_id, started_at, time_bucket(INTERVAL {minutes} MINUTE, event_time) + INTERVAL {minutes} MINUTE AS tick_end,
           max(k) AS k, coalesce(sum(n), 0) AS n
    FROM valid LEFT JOIN counted USING (event_id) GROUP BY ALL
)"""
    return with_views("""
SELECT v.streamer_id, v.category_id, t.tick_end AS snapshot_timestamp, v.viewer_count AS concurrent_viewers,
       coalesce(v.follower_count, 0) AS follower_count,
       CAST(floor(date_diff('microsecond', v.started_at, t.tick_end) / 1e6) AS BIGINT) AS stream_uptime_seconds,
       CAST(t.n AS INTEGER) AS chat_messages_delta, v.started_at
FROM ticks t JOIN valid v ON v.streamer_id = t.streamer_id AND v.started_at = t.started_at AND v.k = t.k""", ctes)


def s15_poll_outcomes(minutes=P.TICK_MINUTES) -> str:
    return with_views(f"""
SELECT time_bucket(INTERVAL {minutes} MINUTE, event_time) + INTERVAL {minutes} MINUTE AS tick_end,
       COUNT(*) FILTER (WHERE viewer_count IS NOT NULL) AS succeeded,
       COUNT(*) FILTER (WHERE viewer_count IS NULL) AS failed
FROM poll_in GROUP BY ALL""", CHAT_POLL)


# ------------------------------------------------- extended statistics, windows


def e20_session_rollup() -> str:
    return with_views(f"""
SELECT broadcast_id,
       CAST(round(AVG(concurrent_viewers), 0) AS INTEGER) AS average_viewers,
       MAX(concurrent_viewers) AS peak_viewers,
       CAST(SUM(chat_messages_delta) AS BIGINT) AS total_chat_messages,
       arg_max(follower_count, ({SNAP_ORDER.replace('bs.', '')})) - arg_min(follower_count, ({SNAP_ORDER.replace('bs.', '')})) AS follower_gain
FROM broadcast_snapshots GROUP BY broadcast_id""")


def e21_e26_extended_stats(as_of=P.AS_OF, window_days=P.WINDOW_DAYS) -> str:
    d = _d(as_of)
    lo, hi = _ts(d - dt.timedelta(days=window_days)), _ts(d + dt.timedelta(days=1))
    plo, phi = _ts(d - dt.timedelta(days=2 * window_days + 1)), _ts(d - dt.timedelta(days=window_days))
    weeks = (window_days + 1) / 7.0
    ctes = f"""
sess AS (
    SELECT broadcast_id, streamer_id, primary_category_id, started_at,
           date_diff('microsecond', started_at, ended_at) / 1e6 / 3600.0 AS duration_hours
    FROM broadcasts WHERE started_at >= {lo} AND started_at < {hi} AND ended_at IS NOT NULL
),
snaps AS (SELECT * FROM broadcast_snapshots WHERE snapshot_timestamp >= {lo} AND snapshot_timestamp < {hi}),
rate AS (
    SELECT broadcast_id, CAST(SUM(chat_messages_delta) AS DOUBLE) / NULLIF(SUM(concurrent_viewers) * 0.25, 0) AS r
    FROM snaps GROUP BY broadcast_id
),
seq AS (
    SELECT s.*, rate.r,
           LAG(primary_category_id) OVER (PARTITION BY s.streamer_id ORDER BY started_at, s.broadcast_id) AS prev_cat,
           date_diff('microsecond', LAG(started_at) OVER (PARTITION BY s.streamer_id ORDER BY started_at, s.broadcast_id), started_at) / 3.6e9 AS gap
    FROM sess s LEFT JOIN rate ON rate.broadcast_id = s.broadcast_id
),
ent AS (
    SELECT streamer_id,
           STDDEV_SAMP(r) AS engagement_consistency,
           coalesce(SUM(CASE WHEN primary_category_id <> prev_cat THEN 1 ELSE 0 END), 0) / {weeks} AS category_switching_frequency,
           COUNT(*) / {weeks} AS streaming_consistency,
           1.0 / (1.0 + STDDEV_SAMP(gap) / NULLIF(AVG(gap), 0)) AS schedule_regularity,
           SUM(duration_hours) AS hours
    FROM seq GROUP BY streamer_id
),
bycat AS (
    SELECT streamer_id, primary_category_id, SUM(duration_hours) AS h
    FROM sess WHERE primary_category_id IS NOT NULL GROUP BY ALL
),
top AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY streamer_id ORDER BY h DESC, primary_category_id) AS rn FROM bycat)
    WHERE rn = 1
),
cur AS (SELECT streamer_id, AVG(concurrent_viewers) AS v FROM snaps GROUP BY streamer_id),
prev AS (
    SELECT streamer_id, AVG(concurrent_viewers) AS pv FROM broadcast_snapshots
    WHERE snapshot_timestamp >= {plo} AND snapshot_timestamp < {phi} GROUP BY streamer_id
)"""
    return with_views("""
SELECT e.streamer_id,
       round(e.engagement_consistency, 6) AS engagement_consistency,
       round(e.category_switching_frequency, 6) AS category_switching_frequency,
       top.primary_category_id AS top_category_id,
       round(top.h / NULLIF(e.hours, 0) * 100, 6) AS top_category_percentage,
       round(e.streaming_consistency, 6) AS streaming_consistency,
       round(e.schedule_regularity, 6) AS schedule_regularity,
       round((cur.v - prev.pv) / NULLIF(prev.pv, 0) * 100, 6) AS viewer_growth_rate
FROM ent e LEFT JOIN top ON top.streamer_id = e.streamer_id
LEFT JOIN cur ON cur.streamer_id = e.streamer_id
LEFT JOIN prev ON prev.streamer_id = e.streamer_id""", ctes)


def m18_candidate_features(as_of=P.AS_OF, window_days=P.WINDOW_DAYS) -> str:
    d = _d(as_of)
    lo_d = d - dt.timedelta(days=window_days)
    lo, hi = _ts(lo_d), _ts(d + dt.timedelta(days=1))
    early = _ts(lo_d + dt.timedelta(days=7))
    ctes = f"""
daily AS (
    SELECT streamer_id, CAST(started_at AS DATE) AS d, SUM(date_diff('microsecond', started_at, ended_at) / 1e6 / 3600.0) AS h
    FROM broadcasts WHERE started_at >= {lo} AND started_at < {hi} AND ended_at IS NOT NULL GROUP BY ALL
),
hv AS (SELECT streamer_id, VAR_SAMP(h) AS hours_per_day_variance FROM daily GROUP BY streamer_id),
snaps AS (SELECT * FROM broadcast_snapshots WHERE snapshot_timestamp >= {lo} AND snapshot_timestamp < {hi}),
sm AS (
    SELECT streamer_id,
           REGR_SLOPE(CAST(concurrent_viewers AS DOUBLE), date_diff('microsecond', {lo}, snapshot_timestamp) / 86400e6) AS viewer_trend,
           arg_max(follower_count, (snapshot_timestamp, follower_count)) AS f_end,
           arg_max(follower_count, (snapshot_timestamp, follower_count)) FILTER (WHERE snapshot_timestamp < {early}) AS f_7,
           AVG(concurrent_viewers) FILTER (WHERE isodow(snapshot_timestamp) IN (6, 7)) AS we,
           AVG(concurrent_viewers) FILTER (WHERE isodow(snapshot_timestamp) NOT IN (6, 7)) AS wd,
           COUNT(*) AS n
    FROM snaps GROUP BY streamer_id
),
cat AS (SELECT streamer_id, category_id, COUNT(*) AS c FROM snaps WHERE category_id IS NOT NULL GROUP BY ALL),
top AS (SELECT streamer_id, MAX(c) AS top FROM cat GROUP BY streamer_id)"""
    return with_views("""
SELECT sm.streamer_id,
       round(hv.hours_per_day_variance, 6) AS hours_per_day_variance,
       round(CASE WHEN isnan(sm.viewer_trend) THEN NULL ELSE sm.viewer_trend END, 6) AS viewer_trend,
       round(CAST(sm.f_end AS DOUBLE) / NULLIF(sm.f_7, 0), 6) AS follower_retention,
       round(CAST(top.top AS DOUBLE) / NULLIF(sm.n, 0), 6) AS top_category_share,
       round(sm.we / NULLIF(sm.wd, 0), 6) AS weekend_weekday_ratio
FROM sm LEFT JOIN top ON top.streamer_id = sm.streamer_id LEFT JOIN hv ON hv.streamer_id = sm.streamer_id""", ctes)


def v5_viewer_rank() -> str:
    return with_views("""
SELECT snapshot_timestamp, concurrent_viewers, broadcast_id,
       CAST(rank() OVER (PARTITION BY snapshot_timestamp ORDER BY concurrent_viewers DESC) AS INTEGER) AS viewer_rank
FROM broadcast_snapshots""")


def v6_follower_delta() -> str:
    return with_views(f"""
SELECT broadcast_id, snapshot_timestamp, follower_count, follower_delta,
       round(follower_delta / NULLIF(date_diff('microsecond', prev_ts, snapshot_timestamp) / 3.6e9, 0), 6) AS follower_delta_per_hour
FROM (
    SELECT bs.*, bs.follower_count - LAG(bs.follower_count) OVER w AS follower_delta,
           LAG(bs.snapshot_timestamp) OVER w AS prev_ts
    FROM broadcast_snapshots bs
    WINDOW w AS (PARTITION BY bs.broadcast_id ORDER BY {SNAP_ORDER})
)""")


# ------------------------------------------------------------ model and metrics

FEATURE_COLS = ["total_broadcasts", "total_broadcast_hours", "first_30d_avg_viewers", "first_30d_chat_rate",
                "first_30d_follower_gain", "first_30d_follower_velocity", "first_30d_unique_categories",
                "first_30d_follower_count", "tune_in_ratio"]


def _scored_ctes() -> str:
    return _training_ctes() + """,
scored AS (
    SELECT streamer_id, is_mega_streamer AS label,
           least(first_30d_avg_viewers / 50.0, 1.0) AS score,
           CAST(least(first_30d_avg_viewers / 50.0, 1.0) >= 0.5 AS INTEGER) AS prediction
    FROM training
),
cm AS (
    SELECT COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
           COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
           COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
           COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
    FROM scored
),
prf AS (
    SELECT *,
           coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS p1, coalesce(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS r1,
           coalesce(CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0), 0) AS p0, coalesce(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0) AS r0
    FROM cm
),
prf2 AS (
    SELECT *, coalesce(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0) AS f1_1, coalesce(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0) AS f1_0,
           tn + fp AS s0, tp + fn AS s1
    FROM prf
),
per_score AS (
    SELECT score, COUNT(*) FILTER (WHERE label = 1) AS n_pos, COUNT(*) FILTER (WHERE label = 0) AS n_neg
    FROM scored GROUP BY score
),
curve AS (
    SELECT score AS threshold,
           SUM(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
           SUM(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
           (SELECT SUM(n_pos) FROM per_score) AS P
    FROM per_score
),
curve2 AS (
    SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
           CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(P, 0) AS recall
    FROM curve
),
curve3 AS (
    SELECT *, coalesce(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1 FROM curve2
)"""


def e28_class_distribution() -> str:
    return with_views("""
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE is_mega_streamer = 0) AS n_negative,
       COUNT(*) FILTER (WHERE is_mega_streamer = 1) AS n_positive,
       CASE WHEN COUNT(*) FILTER (WHERE is_mega_streamer = 1) > 0
            THEN CAST(COUNT(*) FILTER (WHERE is_mega_streamer = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE is_mega_streamer = 1)
            ELSE 'inf'::DOUBLE END AS imbalance_ratio,
       CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE is_mega_streamer = 1) * 100.0 / COUNT(*) ELSE 0 END AS positive_percentage
FROM training""", _training_ctes())


def e29_null_profile() -> str:
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, COUNT(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE))) AS nulls, "
        f"COUNT(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE))) * 100.0 / NULLIF(COUNT(*), 0) AS null_percentage FROM training"
        for c in FEATURE_COLS
    )
    return with_views(parts, _training_ctes())


def e30_describe() -> str:
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, COUNT({c}) AS count, round(AVG(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"round(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std, round(MIN(CAST({c} AS DOUBLE)), 6) AS min, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(MAX(CAST({c} AS DOUBLE)), 6) AS max FROM training"
        for c in FEATURE_COLS
    )
    return with_views(parts, _training_ctes())


def m5_scaler_params() -> str:
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, round(AVG(CAST({c} AS DOUBLE)), 6) AS mean, round(STDDEV_POP(CAST({c} AS DOUBLE)), 6) AS std_pop FROM training"
        for c in FEATURE_COLS
    )
    return with_views(parts, _training_ctes())


def m6_split_counts(test_fraction=0.2) -> str:
    return with_views(f"""
SELECT is_mega_streamer, is_test, row_count FROM (
    SELECT is_mega_streamer, true AS is_test, CAST(round(COUNT(*) * {test_fraction}, 0) AS BIGINT) AS row_count FROM training GROUP BY 1
    UNION ALL
    SELECT is_mega_streamer, false, COUNT(*) - CAST(round(COUNT(*) * {test_fraction}, 0) AS BIGINT) FROM training GROUP BY 1
) WHERE row_count > 0""", _training_ctes())


def m7_class_weight(test_fraction=0.2) -> str:
    return with_views(f"""
SELECT n_negative, n_positive,
       CASE WHEN n_positive > 0 THEN CAST(n_negative AS DOUBLE) / n_positive ELSE 1.0 END AS positive_weight
FROM (
    SELECT CAST(SUM(CASE WHEN is_mega_streamer = 0 THEN c - CAST(round(c * {test_fraction}, 0) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_negative,
           CAST(SUM(CASE WHEN is_mega_streamer = 1 THEN c - CAST(round(c * {test_fraction}, 0) AS BIGINT) ELSE 0 END) AS BIGINT) AS n_positive
    FROM (SELECT is_mega_streamer, COUNT(*) AS c FROM training GROUP BY 1)
)""", _training_ctes())


def e31_score_distribution() -> str:
    return with_views("""
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE prediction = 1) AS predicted_positive,
       COUNT(*) FILTER (WHERE score >= 0.8) AS very_high,
       COUNT(*) FILTER (WHERE score >= 0.6 AND score < 0.8) AS high,
       COUNT(*) FILTER (WHERE score >= 0.4 AND score < 0.6) AS moderate,
       COUNT(*) FILTER (WHERE score >= 0.2 AND score < 0.4) AS low,
       COUNT(*) FILTER (WHERE score < 0.2) AS very_low,
       coalesce(COUNT(*) FILTER (WHERE prediction = 1) * 100.0 / NULLIF(COUNT(*), 0), 0) AS predicted_positive_pct
FROM scored""", _scored_ctes())


def e33_precision_recall() -> str:
    return with_views("""
SELECT tn, fp, fn, tp, round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1_1, 6) AS f1,
       CASE WHEN p1 >= 0.6 AND r1 >= 0.5 THEN 'EXCELLENT'
            WHEN p1 >= 0.5 AND r1 >= 0.4 THEN 'GOOD'
            WHEN p1 >= 0.3 OR r1 >= 0.3 THEN 'MODERATE' ELSE 'POOR' END AS assessment
FROM prf2""", _scored_ctes())


def e34_classification_report() -> str:
    return with_views("""
SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f1_0, 6) AS f1, s0 AS support FROM prf2
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1_1, 6), s1 FROM prf2
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(CAST(tp + tn AS DOUBLE) / NULLIF(s0 + s1, 0), 0), 6), s0 + s1 FROM prf2
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f1_0 + f1_1) / 2, 6), s0 + s1 FROM prf2
UNION ALL SELECT 'weighted avg', round(coalesce((p0 * s0 + p1 * s1) / NULLIF(s0 + s1, 0), 0), 6),
                 round(coalesce((r0 * s0 + r1 * s1) / NULLIF(s0 + s1, 0), 0), 6),
                 round(coalesce((f1_0 * s0 + f1_1 * s1) / NULLIF(s0 + s1, 0), 0), 6), s0 + s1 FROM prf2""", _scored_ctes())


def e35_roc_auc() -> str:
    return with_views("""
SELECT round(SUM(n_pos * (coalesce(neg_lt, 0) + 0.5 * n_neg)) / NULLIF(SUM(n_pos) * SUM(n_neg), 0), 6) AS roc_auc
FROM (SELECT *, SUM(n_neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_lt FROM per_score)""",
        _scored_ctes())


def e36_pr_curve() -> str:
    return with_views("""
SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM curve3""",
        _scored_ctes())


def m15_best_threshold() -> str:
    return with_views("""
SELECT threshold, round(f1, 6) AS f1 FROM curve3 ORDER BY f1 DESC, threshold DESC LIMIT 1""", _scored_ctes())


# ------------------------------------------------------------- streaming runs




def s1_s2_stream_sessions() -> str:
    return s3_sessionize()


def s4_stream_chat_per_session() -> str:
    return s4_chat_per_session()


def s5_stream_carry_over() -> str:
    return s5_chat_delta_carry_over()


def s6_stream_snapshots() -> str:
    return s6_snapshot_ticks()


def s13_stream_message_tail() -> str:
    return s13_message_tail()


def s10_stream_tracked_changes() -> str:
    return with_views(f"""
SELECT streamer_id, started_at, COUNT(*) AS messages, MIN(event_time) AS first_message, MAX(event_time) AS last_message
FROM chat_att WHERE started_at IS NOT NULL AND (streamer_id % 2 <> 1 OR event_time >= TIMESTAMP '{P.TRACKED_LATER}')
GROUP BY streamer_id, started_at""",
        LIFECYCLE + "," + CHAT_POLL + "," + _attach("chat_in", "chat_att"))


def s14_stream_counters() -> str:
    """Every entity that sent anything; sessions that never close expire at the end."""
    ctes = LIFECYCLE + "," + CHAT_POLL + "," + _attach("chat_in", "chat_att") + "," + _attach("poll_in", "poll_att") + """,
said AS (
    SELECT user_id AS streamer_id, event_type, value, event_id FROM events
    WHERE event_type IN ('signup', 'error', 'purchase', 'click') OR (event_type = 'view' AND value >= 5)
)"""
    return with_views("""
SELECT lower('Customer#' || CASE WHEN length(CAST(e.streamer_id AS VARCHAR)) >= 9 THEN CAST(e.streamer_id AS VARCHAR)
         ELSE lpad(CAST(e.streamer_id AS VARCHAR), 9, '0') END) AS login,
       coalesce(s.opened, 0) AS opened, coalesce(s.closed, 0) AS closed, coalesce(s.opened - s.closed, 0) AS expired,
       e.offlines - coalesce(s.closed, 0) AS dropped_offline, coalesce(c.n, 0) AS messages,
       e.chats - coalesce(c.n, 0) AS ignored_messages, coalesce(p.n, 0) AS samples,
       e.polls - coalesce(p.n, 0) AS ignored_samples, CAST(0 AS BIGINT) AS failed_samples
FROM (SELECT streamer_id, count(*) FILTER (event_type = 'error') AS offlines,
             count(*) FILTER (event_type IN ('click', 'view')) AS chats, count(*) FILTER (event_type = 'purchase') AS polls FROM said GROUP BY streamer_id) e
LEFT JOIN (SELECT streamer_id, count(*) AS opened, count(ended_at) AS closed FROM sess GROUP BY streamer_id) s USING (streamer_id)
LEFT JOIN (SELECT streamer_id, count(*) AS n FROM chat_att WHERE started_at IS NOT NULL GROUP BY streamer_id) c USING (streamer_id)
LEFT JOIN (SELECT streamer_id, count(*) AS n FROM poll_att WHERE started_at IS NOT NULL GROUP BY streamer_id) p USING (streamer_id)""", ctes)


def s5_stream_chat_ticks(minutes=P.TICK_MINUTES) -> str:
    return with_views(f"""
SELECT streamer_id, time_bucket(INTERVAL {minutes} MINUTE, event_time) + INTERVAL {minutes} MINUTE AS tick_end,
       COUNT(*) AS chat_messages_delta
FROM chat_in
GROUP BY ALL""", CHAT_POLL)


def s6_stream_poll_ticks(minutes=P.TICK_MINUTES) -> str:
    return with_views(f"""
SELECT streamer_id, tick_end, viewer_count AS concurrent_viewers, category_id, coalesce(follower_count, 0) AS follower_count,
       succeeded, failed
FROM (
    SELECT *, time_bucket(INTERVAL {minutes} MINUTE, event_time) + INTERVAL {minutes} MINUTE AS tick_end,
           row_number() OVER (PARTITION BY streamer_id, time_bucket(INTERVAL {minutes} MINUTE, event_time)
                              ORDER BY event_time DESC, event_id DESC) AS rn,
           COUNT(*) FILTER (WHERE viewer_count IS NOT NULL) OVER (PARTITION BY streamer_id, time_bucket(INTERVAL {minutes} MINUTE, event_time)) AS succeeded,
           COUNT(*) FILTER (WHERE viewer_count IS NULL) OVER (PARTITION BY streamer_id, time_bucket(INTERVAL {minutes} MINUTE, event_time)) AS failed
    FROM poll_in
) WHERE rn = 1""", CHAT_POLL)


def s15_stream_poll_outcomes(minutes=P.TICK_MINUTES) -> str:
    return with_views(f"""
SELECT time_bucket(INTERVAL {minutes} MINUTE, event_time) + INTERVAL {minutes} MINUTE AS tick_end,
       COUNT(*) FILTER (WHERE viewer_count IS NOT NULL) AS succeeded,
       COUNT(*) FILTER (WHERE viewer_count IS NULL) AS failed
FROM poll_in GROUP BY ALL""", CHAT_POLL)


# ------------------------------------------------------------ lookups, counts


def a2_active_entities() -> str:
    return with_views("SELECT streamer_id, username, display_name FROM streamers WHERE is_active ORDER BY streamer_id")


def a3_tracked_entities() -> str:
    return with_views("SELECT streamer_id, username FROM streamers WHERE is_active ORDER BY username, streamer_id")


def a6_open_sessions() -> str:
    return with_views("""
SELECT broadcast_id, streamer_id, started_at, ended_at FROM broadcasts WHERE ended_at IS NULL
ORDER BY started_at DESC, broadcast_id""")


def a7_latest_open_session() -> str:
    return with_views("""
SELECT streamer_id, broadcast_id, started_at FROM (
    SELECT *, row_number() OVER (PARTITION BY streamer_id ORDER BY started_at DESC, broadcast_id DESC) AS rn
    FROM broadcasts WHERE ended_at IS NULL) WHERE rn = 1""")


def a8_snapshot_count() -> str:
    return with_views("SELECT broadcast_id, COUNT(*) AS snapshot_count FROM broadcast_snapshots GROUP BY broadcast_id")


def e37_table_counts() -> str:
    return with_views("""
SELECT 'streamers' AS table_name, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE is_active) AS active_or_live FROM streamers
UNION ALL SELECT 'broadcasts', COUNT(*), COUNT(*) FILTER (WHERE ended_at IS NULL) FROM broadcasts
UNION ALL SELECT 'broadcast_snapshots', COUNT(*), CAST(NULL AS BIGINT) FROM broadcast_snapshots""")


def w2_upsert_entities(now=P.NOW) -> str:
    return with_views(f"""
SELECT coalesce(s.streamer_id, i.streamer_id) AS streamer_id,
       CASE WHEN i.streamer_id IS NOT NULL THEN i.username ELSE s.username END AS username,
       CASE WHEN i.streamer_id IS NOT NULL THEN coalesce(nullif(i.display_name, ''), i.username) ELSE s.display_name END AS display_name,
       coalesce(s.is_active, true) AS is_active,
       CASE WHEN i.streamer_id IS NOT NULL THEN {_ts(_now(now))} END AS updated_at
FROM (SELECT * REPLACE (username AS display_name) FROM streamers WHERE is_active) s
FULL OUTER JOIN (
    SELECT DISTINCT user_id AS streamer_id, lower('Customer#' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0')) AS username,
           'Customer#' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') AS display_name
    FROM events WHERE event_type IN ('click', 'view')
) i ON i.streamer_id = s.streamer_id""")


def w13_engagement_rate() -> str:
    return with_views("""
SELECT broadcast_id, snapshot_timestamp, concurrent_viewers, chat_messages_delta,
       round(CAST(chat_messages_delta AS DOUBLE) / NULLIF(concurrent_viewers, 0), 4) AS engagement_rate
FROM broadcast_snapshots""")


def p15_baseline_tiers() -> str:
    return with_views("""
SELECT s.username, sc.score,
       CASE WHEN sc.score >= 0.8 THEN '🌟 Very High Potential'
            WHEN sc.score >= 0.6 THEN '⭐ High Potential'
            WHEN sc.score >= 0.4 THEN '✓ Moderate Potential'
            WHEN sc.score >= 0.2 THEN '→ Low Potential'
            ELSE '· Very Low Potential' END AS tier,
       CASE WHEN sc.score >= 0.8 THEN 'Priority target - immediate outreach and evaluation.'
            WHEN sc.score >= 0.6 THEN 'Strong candidate - monitor closely and engage.'
            WHEN sc.score >= 0.4 THEN 'Worth watching - periodic check-ins.'
            WHEN sc.score >= 0.2 THEN 'Keep on radar - revisit in 3-6 months.'
            ELSE 'Unlikely candidate - deprioritize.' END AS recommended_action
FROM scored sc JOIN streamers s ON s.streamer_id = sc.streamer_id
ORDER BY sc.score DESC, s.username""", _scored_ctes())


def p8_sparse_predicates(as_of=P.AS_OF) -> str:
    return with_views("""
SELECT 'live_sessions' AS predicate, 'broadcasts' AS table_name, COUNT(*) AS row_count FROM broadcasts WHERE ended_at IS NULL
UNION ALL SELECT 'busy_chat', 'broadcast_snapshots', COUNT(*) FROM broadcast_snapshots WHERE chat_messages_delta > 100
UNION ALL SELECT 'trending', 'categories', COUNT(*) FROM categories WHERE is_trending
UNION ALL SELECT 'has_type', 'categories', COUNT(*) FROM categories WHERE category_type IS NOT NULL
UNION ALL SELECT 'active', 'streamers', COUNT(*) FROM streamers WHERE is_active
UNION ALL SELECT 'has_language', 'streamers', COUNT(*) FROM streamers WHERE broadcaster_language IS NOT NULL
UNION ALL SELECT 'positive_chat_rate', 'streamer_statistics', COUNT(*) FROM d_stats WHERE avg_chat_rate > 0
UNION ALL SELECT 'positive_velocity', 'streamer_statistics', COUNT(*) FROM d_stats WHERE follower_velocity > 0
UNION ALL SELECT 'multi_category', 'streamer_statistics', COUNT(*) FROM d_stats WHERE unique_categories > 1""",
        _stats_ctes(_one_date(as_of), P.WINDOW_DAYS, "d"))


def w5_close_sessions() -> str:
    """Offline events close the newest session still open: balanced pairs of pushes and
    pops.  The end of a session is the first offline at which the running depth
    falls below the depth at its start."""
    return with_views("""
SELECT *, CAST(round(date_diff('microsecond', started_at, ended_at) / 1e6, 0) AS INTEGER) AS duration_seconds
FROM (
    SELECT u.broadcast_id, u.streamer_id, u.t AS started_at, min(o.t) AS ended_at
    FROM placed u JOIN placed o ON o.streamer_id = u.streamer_id AND o.k > u.k AND o.step = -1 AND o.depth < u.depth
    WHERE u.step = 1
    GROUP BY ALL
)""", """
moves AS (
    SELECT streamer_id, started_at AS t, 0 AS o, broadcast_id, 1 AS step FROM broadcasts WHERE ended_at IS NULL
    UNION ALL
    SELECT user_id, ts, 1, 0, -1 FROM events WHERE event_type = 'error'
),
placed AS (
    SELECT *, row_number() OVER w AS k, sum(step) OVER w AS depth
    FROM moves WINDOW w AS (PARTITION BY streamer_id ORDER BY t, o, broadcast_id ROWS UNBOUNDED PRECEDING)
)""")


def d3_tracked_union() -> str:
    return with_views("""
SELECT DISTINCT lower(username) AS username FROM (
    SELECT username FROM streamers WHERE is_active
    UNION ALL
    SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(9, length(CAST(user_id AS VARCHAR))) AS INTEGER), '0') FROM events WHERE event_type IN ('click', 'view')
)""")


def d4_tracked_difference(now=P.NOW, days=P.INACTIVE_DAYS) -> str:
    return with_views("""
SELECT s.username FROM streamers s
WHERE s.is_active AND lower(s.username) NOT IN (SELECT lower(username) FROM inactive)""", _inactive_cte(now, days))


def a4_entity_by_id(streamer_id=P.LOOKUP_ID) -> str:
    return with_views(f"SELECT streamer_id, username, display_name FROM streamers WHERE streamer_id = {streamer_id}")


def a5_entity_by_username(username=P.LOOKUP_NAME) -> str:
    return with_views(f"SELECT streamer_id, username, display_name FROM streamers WHERE lower(username) = lower('{username}')")


def d2_names_not_found() -> str:
    return with_views("""
SELECT username FROM (SELECT channel AS username FROM chat UNION ALL SELECT s_name FROM supplier)
WHERE lower(username) NOT IN (SELECT lower(username) FROM streamers)""", EVENT_VIEWS)


def p6_declared_names(as_of=P.AS_OF) -> str:
    return with_views("""
SELECT streamer_id, calculation_date, total_broadcasts, total_broadcast_hours AS total_streaming_hours, avg_broadcast_duration,
       avg_concurrent_viewers AS average_concurrent_viewers, max_concurrent_viewers AS peak_viewers_30d,
       median_concurrent_viewers AS median_viewers, avg_chat_rate AS average_chat_rate,
       unique_categories AS unique_categories_streamed, follower_gain_30d, latest_follower_count, follower_velocity
FROM d_stats""", _stats_ctes(_one_date(as_of), P.WINDOW_DAYS, "d"))


def p18_ratio_bands() -> str:
    return with_views("""
SELECT CASE WHEN tune_in_ratio > 0.5 THEN 'high' WHEN tune_in_ratio >= 0.1 THEN 'medium' WHEN tune_in_ratio < 0.1 THEN 'low' END AS band,
       count(*) AS entities
FROM training GROUP BY 1""", _training_ctes())


def w6_session_defaults() -> str:
    return with_views("SELECT broadcast_id, coalesce(duration_seconds, 0) AS duration_seconds FROM broadcasts")


def s12_six_hour_ticks() -> str:
    return s6_snapshot_ticks(360)


def s13_message_tail() -> str:
    ctes = LIFECYCLE + "," + CHAT_POLL + "," + _attach("chat_in", "chat_att") + "," + _attach("poll_in", "poll_att") + """,
ends AS (SELECT streamer_id, started_at, max(event_time) AS last FROM poll_att WHERE started_at IS NOT NULL GROUP BY ALL)"""
    return with_views("""
SELECT c.streamer_id, c.started_at, count(*) AS chat_messages_delta
FROM chat_att c LEFT JOIN ends e ON e.streamer_id = c.streamer_id AND e.started_at = c.started_at
WHERE c.started_at IS NOT NULL AND (e.last IS NULL OR c.event_time >= e.last)
GROUP BY ALL""", ctes)


def v8_daily_history() -> str:
    return v8_stats_history(P.DAILY_DATES, P.DAILY_WINDOW)


def p8_sparse_keys(as_of=P.AS_OF) -> str:
    found = [
        ("live_sessions", "broadcasts", "broadcast_id", "broadcasts WHERE ended_at IS NULL"),
        ("has_peak", "broadcasts", "broadcast_id",
         "broadcasts WHERE broadcast_id IN (SELECT broadcast_id FROM broadcast_snapshots WHERE concurrent_viewers IS NOT NULL)"),
        ("busy_chat", "broadcast_snapshots", "broadcast_id", "broadcast_snapshots WHERE chat_messages_delta > 100"),
        ("trending", "categories", "category_id", "categories WHERE is_trending"),
        ("has_igdb", "categories", "category_id", "categories WHERE is_trending"),
        ("has_type", "categories", "category_id", "categories WHERE category_type IS NOT NULL"),
        ("active", "streamers", "streamer_id", "streamers WHERE is_active"),
        ("has_language", "streamers", "streamer_id", "streamers WHERE broadcaster_language IS NOT NULL"),
        ("positive_chat_rate", "streamer_statistics", "streamer_id", "d_stats WHERE avg_chat_rate > 0"),
        ("positive_velocity", "streamer_statistics", "streamer_id", "d_stats WHERE follower_velocity > 0"),
        ("multi_category", "streamer_statistics", "streamer_id", "d_stats WHERE unique_categories > 1"),
        ("positive_growth", "streamer_statistics", "streamer_id", "xs WHERE viewer_growth_rate > 0"),
        ("positive_consistency", "streamer_statistics", "streamer_id", "xs WHERE streaming_consistency > 0"),
    ]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS predicate, '{t}' AS table_name, CAST({k} AS BIGINT) AS id FROM {src}" for n, t, k, src in found)
    ctes = _stats_ctes(_one_date(as_of), P.WINDOW_DAYS, "d") + f",\nxs AS MATERIALIZED (SELECT * FROM ({e21_e26_extended_stats(as_of)}) AS x)"
    return with_views(f"SELECT predicate, table_name, id, count(*) AS row_count FROM ({rows}) AS r GROUP BY ALL", ctes)


def w4_create_sessions() -> str:
    """One session per online event, with the defaults; ids tell events apart."""
    return with_views("""
SELECT user_id AS streamer_id, ts AS started_at, 'stream ' || CAST(event_id AS VARCHAR) AS stream_title,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS primary_category_id, CAST(NULL AS TIMESTAMP) AS ended_at,
       CAST(1 AS BIGINT) AS events, CAST(1 AS BIGINT) AS sessions_of_id
FROM events WHERE event_type = 'signup'""")


def q20_short_discovery(limit=P.SHORT_DISCOVERY_LIMIT) -> str:
    return q20_discovery_summary(limit=limit)


# The features of the classifier.
MODEL_FEATURES = (
    "total_broadcasts", "total_broadcast_hours", "first_30d_avg_viewers", "first_30d_chat_rate", "first_30d_follower_gain",
    "first_30d_follower_velocity", "first_30d_unique_categories", "first_30d_follower_count", "tune_in_ratio",
)


def m12_importance_checks() -> str:
    return f"SELECT unnest({list(MODEL_FEATURES)}) AS feature, true AS not_negative, true AS sums_to_one"


def m17_report_checks(test_fraction=0.2) -> str:
    """The test rows of each class, as the stratified split takes them."""
    ctes = _training_ctes() + f""",
t AS (
    SELECT CAST(is_mega_streamer AS VARCHAR) AS c, CAST(round(count(*) * {test_fraction}, 0) AS BIGINT) AS k
    FROM training GROUP BY is_mega_streamer
)"""
    return with_views("""
SELECT c AS class, k AS support, true AS in_range FROM t
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT CAST(sum(k) AS BIGINT) FROM t), true""", ctes)


def q22_score_checks() -> str:
    columns = ", ".join(MODEL_FEATURES[:-1])
    return with_views(f"SELECT streamer_id, {columns}, true AS decided_by_score, true AS tier_by_score FROM training", _training_ctes())
