"""Golden values on the reference's sample rows (computed by hand, FIXTURES.md §3)."""

import pytest

from vantage.plans import queries as Q

AS_OF = "2025-10-29"


def _by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_rolling_stats_goldens(fixture_tables):
    from vantage.operators.aggregates import rolling_statistics

    t = fixture_tables
    got = _by(rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30), "streamer_id")
    assert set(got) == {1001, 1002, 1003, 1004}  # 1005 has no session: skipped
    a = got[1001]
    assert a["total_broadcasts"] == 3
    assert a["total_broadcast_hours"] == pytest.approx(12.5)
    assert a["avg_broadcast_duration"] == pytest.approx(4.1667, abs=1e-4)
    assert a["avg_concurrent_viewers"] == pytest.approx(168.3333, abs=1e-4)
    assert a["max_concurrent_viewers"] == 220
    assert a["median_concurrent_viewers"] == pytest.approx(165)
    assert a["avg_chat_rate"] == pytest.approx(26.4026, abs=1e-4)
    assert a["unique_categories"] == 1
    assert a["follower_gain_30d"] == 45
    assert a["latest_follower_count"] == 5045
    assert a["follower_velocity"] == pytest.approx(3.6)
    c = got[1003]
    assert (c["total_broadcasts"], c["total_broadcast_hours"]) == (2, pytest.approx(7.0))
    assert c["avg_concurrent_viewers"] == pytest.approx(480.8333, abs=1e-4)
    assert c["max_concurrent_viewers"] == 1200
    assert c["median_concurrent_viewers"] == pytest.approx(350)
    assert c["avg_chat_rate"] == pytest.approx(5.9619, abs=1e-4)
    assert (c["unique_categories"], c["follower_gain_30d"], c["latest_follower_count"]) == (2, 525, 8525)
    assert c["follower_velocity"] == pytest.approx(75.0)
    for k in (1002, 1004):
        z = got[k]
        assert z["avg_concurrent_viewers"] == 0 and z["follower_gain_30d"] == 0 and z["follower_velocity"] == 0
    assert got[1002]["total_broadcast_hours"] == pytest.approx(8.5)


def test_rolling_stats_net_mode(fixture_tables):
    from vantage.operators.aggregates import rolling_statistics

    t = fixture_tables
    got = _by(rolling_statistics(t.streamers, t.broadcasts(), t.snapshots, AS_OF, 30, follower_mode="net"), "streamer_id")
    assert got[1001]["follower_gain_30d"] == 45  # monotone: net == range
    assert got[1003]["follower_gain_30d"] == 525


def test_entity_level_fanout(fixture_tables):
    t = fixture_tables
    q1 = Q.q1_high_engagement(t, as_of=AS_OF, days=30).collect()
    assert [r["username"] for r in q1] == ["hidden_gem_alice"]
    assert q1[0]["avg_engagement_rate"] == pytest.approx(6.322)
    assert q1[0]["engagement_consistency"] == pytest.approx(2.433)
    q4 = _by(Q.q4_follower_velocity(t, as_of=AS_OF, days=30), "username")
    assert q4["hidden_gem_alice"]["total_follower_gain"] == 405
    assert q4["hidden_gem_alice"]["follower_velocity"] == pytest.approx(11.25)
    assert q4["hidden_gem_alice"]["efficiency_score"] == pytest.approx(6.683)
    assert q4["hype_hunter_carol"]["follower_velocity"] == pytest.approx(46.43)
    assert q4["hype_hunter_carol"]["efficiency_score"] == pytest.approx(9.656)
    q5 = Q.q5_hidden_gem_score(t, as_of=AS_OF, days=30).collect()
    assert [r["username"] for r in q5] == ["hype_hunter_carol", "hidden_gem_alice"]
    assert q5[0]["hidden_gem_score"] == pytest.approx(568.36)
    assert q5[1]["hidden_gem_score"] == pytest.approx(283.94)


def test_session_mode_removes_fanout(fixture_tables):
    t = fixture_tables
    q4 = _by(Q.q4_follower_velocity(t, as_of=AS_OF, days=30, fanout="session"), "username")
    assert q4["hidden_gem_alice"]["total_follower_gain"] == 45
    assert q4["hype_hunter_carol"]["total_follower_gain"] == 325


def test_hype_dependency(fixture_tables):
    rows = Q.q3_hype_dependency(fixture_tables).collect()
    got = {(r["username"], r["category_name"]): r for r in rows}
    a = got[("hidden_gem_alice", "League of Legends")]
    assert (a["broadcasts_count"], a["avg_viewers"], a["engagement_rate"], a["total_followers_gained"]) == (9, 168, 6.322, 405)
    c = got[("hype_hunter_carol", "Super Hyped New Game")]
    assert (c["broadcasts_count"], c["avg_viewers"], c["engagement_rate"], c["total_followers_gained"]) == (3, 917, 1.111, 960)
    assert got[("hype_hunter_carol", "League of Legends")]["total_followers_gained"] == 15


def test_retention_curve_session_1(fixture_tables):
    rows = Q.q6_retention_curve(fixture_tables).filter("broadcast_id = 1").orderBy("snapshot_timestamp").collect()
    assert [r["follower_gain_delta"] for r in rows] == [None, 5, 7, 7, 8, 8, 5, 5, 0]


def test_q2_q7_empty_on_base_fixture(fixture_tables):
    assert Q.q2_category_independent(fixture_tables, as_of=AS_OF, days=60).count() == 0
    assert Q.q7_category_switch_impact(fixture_tables).count() == 0
