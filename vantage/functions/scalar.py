"""Scalar expressions (all JVM-side, codegen-friendly; no Python UDFs).

ANSI mode raises on x/0, so every ratio goes through ``safe_div``; NUMERIC
arithmetic is done in DOUBLE (decimal division silently drops digits).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nullif_zero(x) -> Column:
    """F1 ``NULLIF(x, 0)``."""
    return F.nullif(_c(x), F.lit(0))


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)`` in double; NULL when the denominator is 0 or NULL."""
    return _c(num).cast("double") / nullif_zero(_c(den).cast("double"))


def zero_if_null(x) -> Column:
    """F2 ``COALESCE(x, 0)``."""
    return F.coalesce(_c(x), F.lit(0))


def seconds_between(start, end) -> Column:
    """F5 ``EXTRACT(EPOCH FROM end - start)`` as double, microsecond exact."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1e6)


def hours_between(start, end) -> Column:
    """F6 seconds / 3600.0."""
    return seconds_between(start, end) / F.lit(3600.0)


def uptime_seconds(started_at, now) -> Column:
    """F22 whole seconds since the session started, truncated."""
    return F.floor(seconds_between(started_at, now))


def percent_change(new, old) -> Column:
    """F12 ``(new - old) / NULLIF(old, 0) * 100``."""
    return safe_div(_c(new) - _c(old), old) * F.lit(100.0)


def eps_ratio(num, den, eps: float = 1e-6) -> Column:
    """F20 + F21: ``num / (den + eps)`` with +-inf and NaN mapped to NULL."""
    r = _c(num).cast("double") / (_c(den).cast("double") + F.lit(eps))
    bad = F.isnan(r) | (F.abs(r) == F.lit(float("inf")))
    return F.when(bad, F.lit(None).cast("double")).otherwise(r)


def empty_to_null(x) -> Column:
    """F16 ``NULLIF(s, '')``."""
    return F.nullif(_c(x), F.lit(""))


def id_from_string(x) -> Column:
    """F15 string id -> BIGINT; empty or malformed -> NULL."""
    return empty_to_null(x).try_cast("bigint")


def with_default(x, default: str) -> Column:
    """F17 missing or empty -> default text."""
    return F.coalesce(empty_to_null(x), F.lit(default))


def text_prefix(x, n: int = 60, missing: str = "N/A") -> Column:
    """F19 first ``n`` characters or a placeholder."""
    return F.coalesce(F.substring(_c(x), 1, n), F.lit(missing))


def split_list(x) -> Column:
    """F18 comma list -> trimmed, non-empty array (explode it for rows)."""
    parts = F.transform(F.split(_c(x), ","), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != F.lit(""))


def parse_date(x) -> Column:
    """F14 strict ``YYYY-MM-DD``; anything else -> NULL."""
    s = _c(x)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"))


def round_num(x, digits: int = 0) -> Column:
    """F3 ``ROUND(numeric, n)``: half away from zero on the decimal value.

    Double arithmetic leaves noise around exact halves (3.7875 may arrive as
    3.78749999999999996), so the value is first settled at 12 decimals, the
    precision PostgreSQL NUMERIC division carries, and then rounded."""
    return F.round(F.round(_c(x), 12), digits)


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_to_instant(x) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) -> the same instant as TIMESTAMP, without
    going through the session time zone (watermarks need TIMESTAMP)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(x)))


def instant_to_ntz(x) -> Column:
    """TIMESTAMP -> UTC wall time as TIMESTAMP_NTZ (inverse of ``ntz_to_instant``)."""
    micros = F.timestamp_diff("MICROSECOND", F.timestamp_micros(F.lit(0)), _c(x))
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(secs=(micros / F.lit(1e6)).cast("decimal(18,6)"))
