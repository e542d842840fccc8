"""Independent SQL (DuckDB dialect) for the correctness gate.

The SQL restates the driver-table binding of :mod:`vantage.sources.tables` as
CTEs and then each query in plain set-based SQL.  It shares no code with the
Spark plans, so a bug in one side shows up as a mismatch.
"""

from __future__ import annotations

from vantage.sources.tables import DISCOVERY_DAYS, DISCOVERY_START

VIEWS = f"""
streamers AS (
    SELECT c_custkey AS streamer_id,
           lower(c_name) AS username,
           c_name AS display_name,
           c_mktsegment AS broadcaster_language,
           TIMESTAMP '{DISCOVERY_START}'
             + to_days(CAST(c_custkey % {DISCOVERY_DAYS} AS INTEGER))
             + to_hours(CAST((c_custkey * 7) % 24 AS INTEGER))
             - to_days(CAST(365 + (c_custkey * 13) % 2000 AS INTEGER)) AS account_created_at,
           TIMESTAMP '{DISCOVERY_START}'
             + to_days(CAST(c_custkey % {DISCOVERY_DAYS} AS INTEGER))
             + to_hours(CAST((c_custkey * 7) % 24 AS INTEGER)) AS discovered_at,
           c_acctbal > 0 AS is_active
    FROM customer
),
categories AS (
    SELECT p_partkey AS category_id, p_brand AS category_name, p_type AS category_type,
           p_size >= 40 AS is_trending
    FROM part
),
broadcasts AS (
    SELECT o.o_orderkey AS broadcast_id,
           o.o_custkey AS streamer_id,
           pc.primary_category_id,
           o.o_orderpriority AS stream_title,
           o.o_orderpriority = '1-URGENT' AS is_mature,
           o.o_orderdate AS started_at,
           CASE WHEN o.o_orderstatus = 'O' THEN NULL
                ELSE o.o_orderdate + to_hours(CAST(o.o_orderkey % 12 + 1 AS INTEGER)) END AS ended_at,
           CASE WHEN o.o_orderstatus = 'O' THEN NULL
                ELSE CAST((o.o_orderkey % 12 + 1) * 3600 AS INTEGER) END AS duration_seconds,
           CAST(floor(o.o_totalprice / 1000) AS BIGINT) AS follower_gain
    FROM orders o
    LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS primary_category_id
               FROM lineitem GROUP BY l_orderkey) pc ON pc.l_orderkey = o.o_orderkey
),
broadcast_snapshots AS (
    SELECT l.l_orderkey AS broadcast_id,
           o.o_custkey AS streamer_id,
           l.l_partkey AS category_id,
           l.l_shipdate AS snapshot_timestamp,
           CAST(floor(l.l_quantity) - 1 AS INTEGER) AS concurrent_viewers,
           CAST(floor(l.l_extendedprice) AS BIGINT) AS follower_count,
           CAST((l.l_orderkey * 7 + l.l_partkey * 13) % (o.o_custkey % 300 + 1) AS INTEGER)
               AS chat_messages_delta,
           CAST(floor(date_diff('microsecond', o.o_orderdate, l.l_shipdate) / 1e6) AS BIGINT)
               AS stream_uptime_seconds
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
)
"""


def decimal_rounding(sql: str) -> str:
    """Rewrite ``round(x, n)`` as rounding of the decimal value of ``x``.

    PostgreSQL rounds NUMERIC half away from zero on the decimal digits, and
    Spark's ``round`` on a double does the same on the shortest decimal form
    (148.325 -> 148.33).  DuckDB's ``round`` on a double works on the binary
    value (148.32499.. -> 148.32), so the oracle rounds a DECIMAL instead.
    """
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        out.append(sql[i:j])
        k, depth, comma = j + 6, 1, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        arg, digits = sql[j + 6 : comma], sql[comma + 1 : k - 1]
        out.append(f"CAST(round(CAST({decimal_rounding(arg)} AS DECIMAL(38,12)), {digits.strip()}) AS DOUBLE)")
        i = k


def with_views(select: str, ctes: str = "") -> str:
    """``WITH <binding views>[, <ctes>] <select>``."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return decimal_rounding(f"WITH {VIEWS.strip()}{extra}\n{select.strip()}")
