"""Exact percentiles of many columns without a task that sees a whole column.

Rank selection by nested histograms: one pass counts every column's values in
``BINS`` equal ranges between its smallest and largest value; only the range that holds
a wanted rank is counted again, between the smallest and largest value found in it,
until all values in that range are equal.  Where one of the equal ranges kept most of the
values (heavy tails), the next pass divides the logarithms instead.  A pass is one
partial aggregation with at most ``BINS`` rows per column and rank and task, whatever the
number of rows or of distinct values; about ``log(rows) / log(BINS)`` passes are made.

NULL and NaN are missing; infinities are values (smallest and largest).  A column
without values has NULL percentiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.session import reliable_checkpoint

BINS = 512


def present(c: str) -> Column:
    """The value as double, NULL where it is missing."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _on_scale(x: float, logs: bool) -> float:
    """A position that grows with ``x``: halves (no overflow) or signed logarithms."""
    if not logs:
        return x / 2
    return math.copysign(math.log2(abs(x)) + 1100, x) if x else 0.0


def _scale(x: Column, logs: bool) -> Column:
    if not logs:
        return x / 2
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def _bin(x: Column, lo: float, hi: float, logs: bool, bins: int) -> Column:
    """The range of ``x`` in [lo, hi], NULL outside; infinities have ranges of their own."""
    low, high = _on_scale(max(lo, -1.7e308), logs), _on_scale(min(hi, 1.7e308), logs)
    at = F.floor((_scale(x, logs) - F.lit(low)) / F.lit(high - low) * bins) if high > low else F.lit(0)
    at = F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int")
    at = F.when(x == F.lit(float("inf")), F.lit(bins)).when(x == F.lit(float("-inf")), F.lit(-1)).otherwise(at)
    return F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), at)


def exact_percentiles(df: DataFrame, cols: list[str], shares: list[float], bins: int = BINS, stored: bool = False) -> dict[str, list[float | None]]:
    """For every column the interpolated percentiles ``shares`` (0 to 1), equal to
    ``percentile(col, share)`` over the values that are there.  The columns are stored once
    for the passes, unless ``df`` is ``stored`` already."""
    inputs = df.select(*[present(c).alias(f"x{k}") for k, c in enumerate(cols)])
    inputs = inputs if stored else reliable_checkpoint(inputs)
    first = inputs.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in range(len(cols)) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]).first()
    found: dict[tuple[int, int], float] = {}
    # (column, rank) -> the values that may hold it: smallest, largest, whether to divide
    # their logarithms, and how many values lie below
    asked: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
    for k in range(len(cols)):
        for share in shares if first[f"n{k}"] else []:
            at = (first[f"n{k}"] - 1) * share
            for rank in (math.floor(at), math.ceil(at)):
                asked[k, rank] = (first[f"a{k}"], first[f"b{k}"], False, 0)
    while asked:
        for key in [key for key, (lo, hi, _, _) in asked.items() if lo == hi]:
            found[key] = asked.pop(key)[0]
        if not asked:
            break
        ranges = sorted({(k, lo, hi, logs) for (k, _), (lo, hi, logs, _) in asked.items()})
        each = [
            F.struct(F.lit(r).alias("r"), _bin(F.col(f"x{k}"), lo, hi, logs, bins).alias("bin"), F.col(f"x{k}").alias("x"))
            for r, (k, lo, hi, logs) in enumerate(ranges)
        ]
        counted = inputs.select(F.explode(F.array(*each)).alias("e")).select("e.*").where(F.col("bin").isNotNull())
        counted = counted.groupBy("r", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        by_range: dict[tuple, list] = {}
        for row in counted.collect():  # at most bins + 2 rows per range
            by_range.setdefault(ranges[row["r"]], []).append((row["bin"], row["n"], row["a"], row["b"]))
        for (k, rank), (lo, hi, logs, below) in list(asked.items()):
            parts = sorted(by_range[k, lo, hi, logs])
            most = sum(n for _, n, _, _ in parts) / 2
            for _, n, a, b in parts:
                if rank < below + n:
                    asked[k, rank] = (a, b, not logs and n > most, below)
                    break
                below += n
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(cols):
        out[c] = []
        for share in shares:
            if not first[f"n{k}"]:
                out[c].append(None)
                continue
            at = (first[f"n{k}"] - 1) * share
            low, high = math.floor(at), math.ceil(at)
            a, b = found[k, low], found[k, high]
            out[c].append(a if a == b else (high - at) * a + (at - low) * b)
    return out
