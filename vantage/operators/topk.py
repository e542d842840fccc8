"""Sorts, limits and quotas (K1-K6).

A global ``orderBy().limit(k)`` plans as TakeOrderedAndProject: each task keeps
its own top-k and only k rows per task reach the final merge.  Ties are broken
by a unique column so the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """K3/K4/K6 first ``k`` rows by ``order`` (append a unique key to ``order``)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group.  ``row_number() <= k`` lets Spark insert a
    per-task group limit before the shuffle (WindowGroupLimit), so a hot group
    ships at most ``k`` rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def quota(
    listing: DataFrame,
    group: str,
    position: str,
    eligible: Column,
    skipped: Column,
    limit: int,
) -> tuple[DataFrame, DataFrame]:
    """K5 take the first ``limit`` eligible rows of each group in listing order and
    report how far the scan went.

    Returns ``(chosen, summary)`` with summary columns ``processed`` (rows up to
    and including the ``limit``-th choice, or all rows when fewer qualify),
    ``skipped`` (rows flagged by ``skipped`` within that prefix) and ``added``.
    The cut-off comes from a per-group top-``limit`` (bounded per task), so no
    group is ever sorted as a whole."""
    flagged = listing.withColumn("_eligible", eligible).withColumn("_skipped", skipped)
    chosen = top_k_per_group(flagged.filter("_eligible"), [group], [F.col(position).asc()], limit)
    cut = chosen.groupBy(group).agg(F.count(F.lit(1)).alias("added"), F.max(position).alias("_last"))
    j = flagged.join(cut, group, "left").withColumn("_added", F.coalesce("added", F.lit(0)))
    in_prefix = F.col("_last").isNull() | (F.col("_added") < limit) | (F.col(position) <= F.col("_last"))
    summary = j.filter(in_prefix).groupBy(group).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("_skipped")).alias("skipped"),
        F.max("_added").alias("added"),
    )
    return chosen.drop("_eligible", "_skipped"), summary
