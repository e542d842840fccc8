"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a target number of words.  A source's target is met by whole
epochs of it plus one more copy of the documents whose hash lies under a threshold.
The threshold is found by nested histograms: words are summed by source and hash
bucket, the bucket in which the running sum crosses the budget is refined by the
next bits of the hash, and so on for a fixed number of levels at every input size.
Documents are then filtered by comparing their hash; nothing is sorted.

Per source at most ``2 ** LEVEL_BITS`` histogram rows exist at a time.  A hot
source is pre-aggregated by bucket in every task.

Defined results: null or empty text has size 0 and is taken 0 times its words; a
null source is a source of its own, after all others; rows that repeat have equal
hashes and are taken alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.common import SPACE_WORD, stash, with_rank

WEIGHTS = (5, 2, 1)
LEVEL_BITS = 12
LEVELS = 4
HASH_BITS = LEVEL_BITS * LEVELS


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with size (words) and _h (the upper HASH_BITS bits of a hash)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("size", F.regexp_count(text, F.lit(SPACE_WORD)).cast("long")).withColumn(
        "_h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - HASH_BITS)
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    Targets are ``least(cap, level * weight)``; the level rises until the capped
    sources' excess is reshared and no further source is above its cap."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_rank(sums, [F.col("source").asc_nulls_last()], "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stash(
        ranked.withColumn("weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .drop("_rank")
    )
    first = ranked.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if first["w"] is None:
        level = 0.0
    else:
        budget, level = share * first["n"], share * first["n"] / first["w"]
        while True:
            over = F.col("_cap") < F.lit(level) * F.col("weight")
            got = ranked.agg(
                F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)).alias("capped"),
                F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("w"),
            ).first()
            if got["w"] == 0:
                level = float("inf")
                break
            new = (budget - got["capped"]) / got["w"]
            if new <= level:
                break
            level = new
    return ranked.withColumn("target", F.least("_cap", F.lit(level) * F.col("weight"))).drop("_cap")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Add full (whole epochs) and threshold (documents with ``_h`` below it get one
    copy more) to ``goals``, refining one boundary bucket per source and level."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (
        goals.withColumn("full", F.floor(ratio).cast("long"))
        .withColumn("_rest", F.col("target") - F.col("full") * F.col("source_size"))
        .withColumn("_prefix", F.lit(0).cast("long"))
    )
    keep = state.columns
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("_h", shift)
        hist = sized.select(F.col("source").alias("_s"), bucket.alias("_b"), "size")
        # level 0 sums all rows; deeper levels read only rows of the boundary buckets
        if level:
            edge = state.select(F.col("source").alias("_e"), F.col("_prefix").alias("_p"))
            hist = hist.join(
                edge, F.col("_s").eqNullSafe(F.col("_e")) & (F.shiftright("_b", LEVEL_BITS) == F.col("_p")), "left_semi"
            )
        hist = hist.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
        run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        joined = state.join(hist, F.col("source").eqNullSafe(F.col("_s")))
        fits = joined.where(F.col("_before") <= F.col("_rest"))
        best = fits.groupBy("_s").agg(F.max(F.struct("_b", "_before", "_n")).alias("_x"))
        state = stash(
            state.join(best, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("_rest", F.col("_rest") - F.col("_x._before"))
            .withColumn("_prefix", F.col("_x._b"))
            .withColumn("_last", F.col("_x._n"))
            .select(*keep, "_last")
        )
    take = (2 * F.col("_rest") >= F.col("_last")) & (F.col("_last") > 0)
    return state.withColumn("threshold", F.col("_prefix") + F.when(take, 1).otherwise(0)).drop("_rest", "_prefix", "_last")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(slim measured rows doc_id, source, size, _h; one row per source)."""
    slim = stash(measure(docs.select("doc_id", "text", "source")).select("doc_id", "source", "size", "_h"))
    return slim, stash(thresholds(slim, targets(slim, weights, share, max_epochs)))


def copies(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Measured rows with source_size, target and copies of their source's plan."""
    p = per_source.select(F.col("source").alias("_ps"), "source_size", "target", "full", "threshold")
    sized = sized.drop("source_size", "target", "full", "threshold", "copies")
    return (
        sized.join(p, F.col("source").eqNullSafe(F.col("_ps")))
        .withColumn("copies", F.col("full") + F.when(F.col("_h") < F.col("threshold"), 1).otherwise(0))
        .drop("_ps", "full", "threshold")
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    cols = docs.columns
    _, per_source = plan(docs, weights, share, max_epochs)
    taken = copies(measure(docs), per_source).where(F.col("copies") > 0)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*cols)
