"""The sample rows of the five tables (for tests and examples only).

Registered queries never read this; they run on the driver's tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from vantage.sources.tables import (
    BROADCASTS_SCHEMA,
    CATEGORIES_SCHEMA,
    SNAPSHOTS_SCHEMA,
    STREAMERS_SCHEMA,
    DomainTables,
)


def _t(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


# Sample entities (id, username, display name, account created,
# discovered, language, description).
ENTITIES = [
    (1001, "hidden_gem_alice", "HiddenGemAlice", "2023-01-15 10:00:00", "2025-10-01 12:00:00", "en", "Variety streamer with high engagement"),
    (1002, "rising_bob", "RisingBob", "2022-06-20 14:30:00", "2025-10-05 09:15:00", "en", "Focused on personality-driven content"),
    (1003, "hype_hunter_carol", "HypeHunterCarol", "2024-03-10 08:00:00", "2025-10-10 16:45:00", "en", "Plays trending games exclusively"),
    (1004, "consistent_dave", "ConsistentDave", "2021-11-05 11:20:00", "2025-09-15 10:00:00", "en", "Streams daily with loyal community"),
    (1005, "versatile_eve", "VersatileEve", "2023-08-22 13:00:00", "2025-10-12 14:30:00", "es", "Multi-category streamer"),
]

# Sample categories (id, name, type, trending, first seen).
CATEGORIES = [
    (2001, "League of Legends", "game", False, "2025-09-01 00:00:00"),
    (2002, "Just Chatting", "creative", False, "2025-09-01 00:00:00"),
    (2003, "Valorant", "game", True, "2025-09-15 00:00:00"),
    (2004, "Minecraft", "game", False, "2025-09-01 00:00:00"),
    (2005, "Super Hyped New Game", "game", True, "2025-10-20 00:00:00"),
    (2006, "Art", "creative", False, "2025-09-01 00:00:00"),
]

# Sample sessions (id, entity, category, title, start, end,
# seconds, average viewers, peak viewers, chat messages, follower gain).
SESSIONS = [
    (1, 1001, 2001, "Climbing the ranks!", "2025-10-20 14:00:00", "2025-10-20 18:00:00", 14400, 150, 220, 8500, 45),
    (2, 1001, 2002, "Just vibing and chatting", "2025-10-22 16:00:00", "2025-10-22 19:30:00", 12600, 180, 250, 12000, 62),
    (3, 1001, 2004, "Building a community server", "2025-10-24 15:00:00", "2025-10-24 20:00:00", 18000, 165, 210, 9800, 51),
    (4, 1002, 2002, "Story time and Q&A", "2025-10-21 12:00:00", "2025-10-21 16:00:00", 14400, 200, 280, 15000, 78),
    (5, 1002, 2002, "Community game night", "2025-10-23 13:00:00", "2025-10-23 17:30:00", 16200, 210, 295, 16500, 85),
    (6, 1003, 2005, "NEW GAME HYPE!!!", "2025-10-25 10:00:00", "2025-10-25 15:00:00", 18000, 850, 1200, 12000, 320),
    (7, 1003, 2001, "Trying League...", "2025-10-26 11:00:00", "2025-10-26 13:00:00", 7200, 45, 60, 800, 5),
    (8, 1004, 2001, "Daily League grind", "2025-10-27 18:00:00", "2025-10-27 22:00:00", 14400, 95, 110, 7500, 12),
]

# Sample snapshots (session, entity, category, time, viewers,
# followers, chat messages, uptime seconds).
SNAPSHOTS = [
    (1, 1001, 2001, "2025-10-20 14:00:00", 120, 5000, 0, 0),
    (1, 1001, 2001, "2025-10-20 14:30:00", 145, 5005, 950, 1800),
    (1, 1001, 2001, "2025-10-20 15:00:00", 160, 5012, 1100, 3600),
    (1, 1001, 2001, "2025-10-20 15:30:00", 155, 5019, 1050, 5400),
    (1, 1001, 2001, "2025-10-20 16:00:00", 165, 5027, 1200, 7200),
    (1, 1001, 2001, "2025-10-20 16:30:00", 170, 5035, 1250, 9000),
    (1, 1001, 2001, "2025-10-20 17:00:00", 220, 5040, 1800, 10800),
    (1, 1001, 2001, "2025-10-20 17:30:00", 200, 5045, 1500, 12600),
    (1, 1001, 2001, "2025-10-20 18:00:00", 180, 5045, 1150, 14400),
    (6, 1003, 2005, "2025-10-25 10:00:00", 650, 8000, 0, 0),
    (6, 1003, 2005, "2025-10-25 11:00:00", 900, 8100, 1500, 3600),
    (6, 1003, 2005, "2025-10-25 12:00:00", 1200, 8200, 2000, 7200),
    (7, 1003, 2001, "2025-10-26 11:00:00", 50, 8520, 0, 0),
    (7, 1003, 2001, "2025-10-26 12:00:00", 40, 8522, 400, 3600),
    (7, 1003, 2001, "2025-10-26 13:00:00", 45, 8525, 400, 7200),
]


def load_fixture(spark: SparkSession, extra_sessions=(), extra_snapshots=()) -> DomainTables:
    created = _t("2025-10-01 00:00:00")
    ents = spark.createDataFrame(
        [
            (i, u, d, None, desc, lang, _t(acc), _t(disc), None, True, created, created)
            for i, u, d, acc, disc, lang, desc in ENTITIES
        ],
        STREAMERS_SCHEMA,
    )
    cats = spark.createDataFrame(
        [(i, n, ty, None, None, tr, _t(fs), None) for i, n, ty, tr, fs in CATEGORIES], CATEGORIES_SCHEMA
    )
    sess = spark.createDataFrame(
        [
            (i, e, c, title, False, _t(s), _t(en) if en else None, secs, av, pk, msgs, gain)
            for i, e, c, title, s, en, secs, av, pk, msgs, gain in list(SESSIONS) + list(extra_sessions)
        ],
        BROADCASTS_SCHEMA,
    )
    snaps = spark.createDataFrame(
        [
            (b, e, c, _t(ts), v, f, m, up, None)
            for b, e, c, ts, v, f, m, up in list(SNAPSHOTS) + list(extra_snapshots)
        ],
        SNAPSHOTS_SCHEMA,
    )
    return DomainTables(ents, cats, sess, snaps)
