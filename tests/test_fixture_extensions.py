"""Extension rows (FIXTURES.md §4) with hand-computed expectations."""

import pytest

from vantage.plans import queries as Q
from vantage.sources.fixture import load_fixture

AS_OF = "2025-10-29"

SESSIONS = [
    # entity 1005: two sessions in each of two categories (Q2)
    (9, 1005, 2002, "a", "2025-10-10 10:00:00", "2025-10-10 12:00:00", 7200, None, None, None, 10),
    (10, 1005, 2002, "b", "2025-10-11 10:00:00", "2025-10-11 12:00:00", 7200, None, None, None, 10),
    (11, 1005, 2006, "c", "2025-10-12 10:00:00", "2025-10-12 12:00:00", 7200, None, None, None, 10),
    (12, 1005, 2006, "d", "2025-10-13 10:00:00", "2025-10-13 12:00:00", 7200, None, None, None, 10),
    # entity 1004: one session that changes category (Q7), and one still open
    (13, 1004, 2001, "e", "2025-10-28 10:00:00", "2025-10-28 11:00:00", 3600, None, None, None, 1),
    (14, 1004, 2001, "f", "2025-10-28 20:00:00", None, None, None, None, None, 1),
]
SNAPSHOTS = [
    (9, 1005, 2002, "2025-10-10 10:15:00", 100, 10, 200, 900),
    (10, 1005, 2002, "2025-10-11 10:15:00", 100, 10, 400, 900),
    (11, 1005, 2006, "2025-10-12 10:15:00", 50, 10, 50, 900),
    (12, 1005, 2006, "2025-10-13 10:15:00", 50, 10, 150, 900),
    (13, 1004, 2001, "2025-10-28 10:00:00", 100, 20, 5, 0),
    (13, 1004, 2003, "2025-10-28 10:15:00", 0, 20, 5, 900),
    (13, 1004, 2001, "2025-10-28 10:30:00", 30, 21, 5, 1800),
    (13, 1004, None, "2025-10-28 10:45:00", 50, 22, 5, 2700),
]


@pytest.fixture(scope="module")
def ext(spark):
    return load_fixture(spark, SESSIONS, SNAPSHOTS)


def test_q2_versatility(ext):
    rows = Q.q2_category_independent(ext, as_of=AS_OF, days=60).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.username == "versatile_eve" and r.categories_count == 2
    assert r.overall_avg_engagement == pytest.approx(2.5)
    assert r.engagement_variance == pytest.approx(0.707)
    assert (r.min_category_engagement, r.max_category_engagement) == (pytest.approx(2.0), pytest.approx(3.0))
    assert r.versatility_rating == "VERSATILE"


def test_q7_switches_with_null_and_zero(ext):
    rows = Q.q7_category_switch_impact(ext).collect()
    got = [(r.from_category, r.to_category, r.viewers_before_switch, r.viewers_after_switch, r.viewer_change, r.percent_change) for r in rows]
    # ordered by viewer change descending; NULL category rows drop; 0 previous viewers -> NULL percent
    assert got == [("Valorant", "League of Legends", 0, 30, 30, None), ("League of Legends", "Valorant", 100, 0, -100, -100.0)]


def test_open_session_excluded_from_rolling_stats(ext):
    from vantage.operators.aggregates import rolling_statistics

    got = {r.streamer_id: r for r in rolling_statistics(ext.streamers, ext.broadcasts(), ext.snapshots, AS_OF, 30).collect()}
    assert got[1004].total_broadcasts == 2  # session 8 and 13 completed; 14 open
    assert got[1004].max_concurrent_viewers == 100
    assert got[1004].unique_categories == 2  # NULL category not counted
    assert got[1005].total_broadcasts == 4


def test_zero_viewers_engagement_is_null(ext):
    rows = Q.q6_retention_curve(ext).filter("broadcast_id = 13").orderBy("snapshot_timestamp").collect()
    assert [r.engagement_rate for r in rows] == [0.05, None, pytest.approx(0.167), 0.1]
    assert [r.follower_gain_delta for r in rows] == [None, 0, 1, 1]
