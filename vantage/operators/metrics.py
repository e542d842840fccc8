"""Exact evaluation metrics over (label, score, prediction) columns.

Everything is an aggregate over the scored rows; curves aggregate per distinct
score first and accumulate over equi-depth score ranges, so no step sorts all
rows in one task or collects them to the driver, however the scores are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import safe_div
from vantage.operators.quantiles import exact_percentiles, present
from vantage.operators.sequence import ranged_running_sums
from vantage.session import reliable_checkpoint

# Score buckets of the scoring report (lower bound inclusive).
SCORE_BUCKETS = (("very_high", 0.8, None), ("high", 0.6, 0.8), ("moderate", 0.4, 0.6), ("low", 0.2, 0.4), ("very_low", None, 0.2))


def class_distribution(df: DataFrame, label: str = "is_mega_streamer") -> DataFrame:
    """E28 n0, n1, imbalance ratio (inf without positives), positive percentage."""
    y = F.col(label)
    g = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(y == 0).alias("n_negative"), F.count_if(y == 1).alias("n_positive"))
    return g.select(
        "total",
        "n_negative",
        "n_positive",
        F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")).otherwise(F.lit(float("inf"))).alias("imbalance_ratio"),
        F.when(F.col("total") > 0, F.col("n_positive") * 100.0 / F.col("total")).otherwise(F.lit(0.0)).alias("positive_percentage"),
    )


def null_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """E29 NULL count and percentage per column (one pass, long format)."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.selectExpr("_n", f"stack({len(cols)}, {stack}) AS (feature, nulls)")
    return long.select("feature", "nulls", safe_div(F.col("nulls") * 100.0, "_n").alias("null_percentage"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """E30 count, mean, sample std, min, exact interpolated quartiles, max per column;
    NULL and NaN are missing.  The moments are one aggregation, the quartiles come from
    nested histograms (:mod:`vantage.operators.quantiles`)."""
    df = reliable_checkpoint(df.select(*cols))
    quartiles = exact_percentiles(df, cols, [0.25, 0.5, 0.75], stored=True)
    aggs = []
    for c in cols:
        x = present(c)
        p25, p50, p75 = (F.lit(v).cast("double") for v in quartiles[c])
        aggs.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                p25.alias("p25"),
                p50.alias("p50"),
                p75.alias("p75"),
                F.max(x).alias("max"),
            ).alias(c)
        )
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("d")).select("d.*")


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """E32 one row: tn, fp, fn, tp."""
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _prf(tp, fp, fn):
    precision = F.coalesce(safe_div(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(safe_div(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(safe_div(2 * precision * recall, precision + recall), F.lit(0.0))
    return precision, recall, f1


def precision_recall_f1(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """E33 class-1 precision, recall, F1 with zero_division = 0."""
    c = confusion(df, label, pred)
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("tn", "fp", "fn", "tp", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """E34 per class precision/recall/F1/support, then accuracy, macro and
    weighted averages (long format, one row per line of the report)."""
    c = confusion(df, label, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    p1, r1, f1 = _prf(tp, fp, fn)
    p0, r0, f0 = _prf(tn, fn, fp)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1
    rows = c.select(
        F.array(
            F.struct(F.lit("0").alias("class"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
            F.struct(F.lit("1").alias("class"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
            F.struct(
                F.lit("accuracy").alias("class"),
                F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                F.coalesce(safe_div(tp + tn, n), F.lit(0.0)).alias("f1"),
                n.alias("support"),
            ),
            F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"), ((f0 + f1) / 2).alias("f1"), n.alias("support")),
            F.struct(
                F.lit("weighted avg").alias("class"),
                F.coalesce(safe_div(p0 * s0 + p1 * s1, n), F.lit(0.0)).alias("precision"),
                F.coalesce(safe_div(r0 * s0 + r1 * s1, n), F.lit(0.0)).alias("recall"),
                F.coalesce(safe_div(f0 * s0 + f1 * s1, n), F.lit(0.0)).alias("f1"),
                n.alias("support"),
            ),
        ).alias("r")
    )
    return rows.select(F.explode("r").alias("x")).select("x.*")


def _per_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives / negatives per distinct score."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E35 exact ROC-AUC = P(score+ > score-) + 0.5 P(tie), i.e. the rank-sum
    statistic with average ranks for ties.  NULL when one class is missing."""
    c = ranged_running_sums(_per_score(df, label, score), "score", {"_neg_le": "n_neg"})
    pairs = F.col("n_pos") * (F.col("_neg_le") - F.col("n_neg") + 0.5 * F.col("n_neg"))
    return c.agg(
        safe_div(F.sum(pairs), F.sum("n_pos") * F.sum("n_neg")).alias("roc_auc"),
    )


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """E36 precision, recall and F1 when predicting positive for score >= t, for
    every distinct score t (recall decreasing as t rises)."""
    c = ranged_running_sums(_per_score(df, label, score), "score", {"tp": "n_pos", "fp": "n_neg"}, descending=True)
    precision = safe_div("tp", F.col("tp") + F.col("fp"))
    recall = safe_div("tp", "tp_total")
    f1 = F.coalesce(safe_div(2 * precision * recall, precision + recall), F.lit(0.0))
    return c.select(F.col("score").alias("threshold"), "tp", "fp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """M15 the threshold with the highest F1 (ties -> the higher threshold)."""
    return curve.agg(
        F.max_by("threshold", F.struct("f1", "threshold")).alias("threshold"), F.max("f1").alias("f1")
    )


def score_distribution(df: DataFrame, score: str = "score", pred: str = "prediction") -> DataFrame:
    """E31 counts per score bucket plus predicted positives and their share."""
    s = F.col(score)
    aggs = []
    for name, lo, hi in SCORE_BUCKETS:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (s >= lo)
        if hi is not None:
            cond = cond & (s < hi)
        aggs.append(F.count_if(cond).alias(name))
    g = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(pred) == 1).alias("predicted_positive"), *aggs)
    return g.withColumn("predicted_positive_pct", F.coalesce(safe_div(F.col("predicted_positive") * 100.0, "total"), F.lit(0.0)))
