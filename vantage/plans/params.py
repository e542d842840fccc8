"""Parameters of the registered queries on the driver tables.

The reference reads ``CURRENT_DATE`` / ``NOW()``; here the clock is always a
parameter.  The driver's orders run 1995-01..2001-08 with about ten sessions per
entity, so a 30-day window is sparse; the defaults use a one-year window inside
the data range and the reference's own lengths are kept as named parameters.
"""

AS_OF = "2000-01-01"          # calculation / "current" date
WINDOW_DAYS = 365             # Q8 rolling window (reference: 30)
RECENT_DAYS = 365             # Q1, Q4, Q5 "last 30 days" (reference: 30)
RECENT_DAYS_Q2 = 730          # Q2 "last 60 days" (reference: 60)
MULTI_CAT_DAYS = 730          # Q14 "last 60 days" (reference: 60)
NOW = "2001-08-29 00:00:00"   # instant for discovery and freshness queries
DISCOVERY_RECENT_DAYS = 7
FRESHNESS_SECONDS = 3600 * 24 * 30
STATS_DATES = ("1996-01-06", "2001-07-01", 91)  # first, last, step (days): a grid through AS_OF
DAILY_DATES, DAILY_WINDOW = ("1997-03-01", "1997-06-30", 1), 30  # every day of four months
LABEL_THRESHOLD = 40.0        # Q10 peak avg viewers for the positive class (reference: 17000), ~10% positives
MIN_HOURS = 10.0              # Q10 first-record hours floor
MIN_LISTING_VIEWERS = 100     # Q20 viewer range (inclusive)
MAX_LISTING_VIEWERS = 300
DISCOVERY_LIMIT = 5           # Q20 new entities per category
SHORT_DISCOVERY_LIMIT = 2     # Q20 a limit that categories of the test data reach
REPLAY_DAYS = 30              # W1: the ingestion re-sends this many days before AS_OF
INACTIVE_DAYS = 365           # W16/W18 entities without activity for this long
ARCHIVE_AFTER_DAYS = 365      # A19 snapshots older than NOW - this go to the archive
TICK_MINUTES = 15             # S6 poll interval (reference default)
# Lengths of the entity columns in the registered check (the test data's longest language has 10)
ENTITY_LENGTHS = {"username": 25, "display_name": 25, "broadcaster_language": 9}
LOOKUP_ID, LOOKUP_NAME = 42, "CUSTOMER#000000042"
# Replay of the live service: events arrive up to this late; no session of the data is longer than a year
LATE_SECONDS = 6 * 3600
MAX_SESSION_HOURS = 366 * 24
TRACKED_SINCE, TRACKED_LATER = "2000-01-01 00:00:00", "2024-01-15 00:00:00"
