"""Skew-safe ordered operators: LAG / LEAD and running sums split by time bucket.

A window ``PARTITION BY key ORDER BY t`` sorts each key inside one task; a key
holding a third of the data would be one task.  Here every ordered pass runs on
``(key, bucket)`` partitions (e.g. one day of one entity) and only a per-bucket
summary row crosses bucket borders.  The bucket-level pass per key sees at most
(time span / bucket width) rows, a bound set by parameters, not by data volume.

``bucket`` must be non-decreasing in the ordering (e.g. the day of the
timestamp that leads the ordering).  Ordering columns sort ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.session import reliable_checkpoint

_UNB = Window.unboundedPreceding


def _dealt(df: DataFrame, partition: list[str], bucket: Column) -> DataFrame:
    """``df`` dealt by (partition, bucket ``_b``), all its columns packed in ``_row``.

    The rows and the bucket edges are two uses of this one exchange: as every row is one
    value, both need the same columns, so the second use reads the shuffle files of
    the first and the input is read once."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    return df.withColumn("_b", bucket).select(*partition, "_b", whole).repartition(*partition, "_b")


def day_bucket(ts: str) -> Column:
    """Days since the epoch of a timestamp (a non-decreasing bucket of it)."""
    return F.datediff(F.to_date(F.col(ts)), F.lit("1970-01-01").cast("date"))


def shift(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    cols: list[str],
    bucket: Column,
    direction: str = "lag",
    prefix: str | None = None,
) -> DataFrame:
    """Adds ``<prefix><col>``: the value of ``col`` in the previous (``lag``) or next
    (``lead``) row of the same partition in ``order`` order, as
    ``LAG/LEAD(col) OVER (PARTITION BY partition ORDER BY order)`` would."""
    if direction not in ("lag", "lead"):
        raise ValueError("direction must be 'lag' or 'lead'")
    prefix = prefix if prefix is not None else ("prev_" if direction == "lag" else "next_")
    keys = [*partition, "_b"]
    dealt = _dealt(df, partition, bucket)
    place = [F.col(f"_row.{c}") for c in order]
    w = Window.partitionBy(*keys).orderBy(*(place if direction == "lag" else [c.desc() for c in place]))
    # lag over the reversed order is lead
    x = dealt.select("*", F.lag("_row").over(w).alias("_loc"))
    rank = F.struct(*place)
    edge = F.max_by("_row", rank) if direction == "lag" else F.min_by("_row", rank)
    edges = dealt.groupBy(*keys).agg(edge.alias("_edge"))
    wb = Window.partitionBy(*keys[:-1]).orderBy("_b")
    nb = F.lag("_edge").over(wb) if direction == "lag" else F.lead("_edge").over(wb)
    edges = edges.select(*keys, nb.alias("_nb"))
    j = x.join(edges, keys, "left").select("_row", F.coalesce("_loc", "_nb").alias("_near"))
    return j.select("_row.*", *[F.col(f"_near.{c}").alias(prefix + c) for c in cols])


def running_sum(
    df: DataFrame,
    partition: list[str],
    order: list[str],
    value: str,
    bucket: Column,
    out: str = "run_sum",
    min_before: str | None = None,
) -> DataFrame:
    """Adds ``out`` = SUM(value) over rows up to and including the current one, and
    optionally ``min_before`` = the minimum of ``out`` over the strictly earlier
    rows of the partition (NULL on the first row)."""
    keys = [*partition, "_b"]
    dealt = _dealt(df, partition, bucket)
    v = F.col(f"_row.{value}")
    w = Window.partitionBy(*keys).orderBy(*[F.col(f"_row.{c}") for c in order])
    x = dealt.select("*", F.sum(v).over(w.rowsBetween(_UNB, Window.currentRow)).alias("_ls"))
    if min_before:
        x = x.withColumn("_lmin", F.min("_ls").over(w.rowsBetween(_UNB, -1)))
        g = x.groupBy(*keys).agg(F.sum(v).alias("_bt"), F.min("_ls").alias("_bmin"))
    else:
        g = dealt.groupBy(*keys).agg(F.sum(v).alias("_bt"))
    wb = Window.partitionBy(*keys[:-1]).orderBy("_b")
    before = wb.rowsBetween(_UNB, -1)
    g = g.withColumn("_off", F.coalesce(F.sum("_bt").over(before), F.lit(0)))
    if min_before:
        g = g.withColumn("_pmin", F.min(F.col("_off") + F.col("_bmin")).over(before)).drop("_bmin")
    j = x.join(g.drop("_bt"), keys, "left")
    found = [(F.col("_off") + F.col("_ls")).alias(out)]
    if min_before:
        found.append(F.least(F.col("_pmin"), F.col("_off") + F.col("_lmin")).alias(min_before))
    return j.select("_row.*", *found)


def ranged_running_sums(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds, for every ``out: value`` of ``sums``, the SUM(value) over all rows up to and
    including the current one in ``order`` order as ``out``, and over all rows as
    ``<out>_total``.  ``order`` is unique and numeric.

    The rows are dealt into ranges of about equal numbers of rows (sampled bounds, so any
    spread of values gives even ranges) and stored once; the sums of the ranges, one row
    each, are accumulated and joined back to the running sums within each range."""
    by = F.col(order).desc() if descending else F.col(order).asc()
    rows = reliable_checkpoint(df)  # read twice: for the sampled bounds and for the ranges
    dealt = reliable_checkpoint(rows.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    per_range = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{o}") for o, v in sums.items()])
    before = Window.orderBy("_part").rowsBetween(_UNB, -1)  # as many rows as there are ranges
    offsets = per_range.select(
        "_part",
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_s_{o}").over(Window.orderBy("_part").rowsBetween(_UNB, Window.unboundedFollowing)).alias(f"{o}_total") for o in sums],
    )
    own = Window.partitionBy("_part").orderBy(by).rowsBetween(_UNB, Window.currentRow)
    inside = dealt.select("*", *[F.sum(v).over(own).alias(f"_w_{o}") for o, v in sums.items()])
    joined = inside.join(F.broadcast(offsets), "_part")
    out = joined.select("*", *[(F.col(f"_o_{o}") + F.col(f"_w_{o}")).alias(o) for o in sums])
    return out.drop("_part", *[f"_{k}_{o}" for k in "ow" for o in sums])
