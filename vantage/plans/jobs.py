"""End-to-end jobs over stored domain tables: daily statistics and backfill,
model training, batch scoring and discovery.  Each returns a small summary;
the data stays in Spark.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators import aggregates as agg
from vantage.operators import quality as Qa
from vantage.operators import topk as K
from vantage.operators import writes as W
from vantage.operators.filters import validate_range
from vantage.operators.ml import training_set
from vantage.operators.model import evaluate, feature_importance, save_model, score, train
from vantage.session import reliable_checkpoint
from vantage.sources import files as Fi
from vantage.sources.tables import DomainTables, read_table


def daily_statistics(
    tables: DomainTables, stats_path: str, as_of, window_days: int = 30, dry_run: bool = False
) -> dict:
    """Rolling statistics for every active entity on ``as_of``; rows failing the
    statistics CHECK go to ``<stats_path>_quarantine``; the date's partition is
    replaced (idempotent rerun).  ``dry_run`` computes without writing (W12)."""
    stats = agg.rolling_statistics(tables.streamers, tables.broadcasts(), tables.snapshots, as_of, window_days, keep_empty=True)
    stats = reliable_checkpoint(stats)  # computed once for the counts and both writes
    summary = (
        stats.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("total_broadcasts") > 0).alias("written"),
            F.count_if(F.col("total_broadcasts") == 0).alias("skipped"),
        )
        .first()
        .asDict()
    )
    if dry_run:
        return {**summary, "written": 0, "would_write": summary["written"], "failed": 0}
    valid, bad = Qa.validate_checks(stats.filter(F.col("total_broadcasts") > 0), Qa.CHECKS["streamer_statistics"])
    W.write_stats_partition(valid, stats_path)
    failed = bad.count()
    if failed:
        bad.write.mode("append").parquet(f"{stats_path.rstrip('/')}_quarantine")
    return {**summary, "written": summary["written"] - failed, "failed": failed}


def backfill(tables: DomainTables, stats_path: str, first: str, last: str, window_days: int = 30) -> dict:
    """Every day of ``[first, last)`` in one job (the reference's shell loop)."""
    days = (dt.date.fromisoformat(last) - dt.date.fromisoformat(first)).days
    if days <= 0:
        return {"dates": 0}
    last_incl = (dt.date.fromisoformat(last) - dt.timedelta(days=1)).isoformat()
    hist = agg.stats_history(tables.streamers, tables.broadcasts(), tables.snapshots, first, last_incl, 1, window_days)
    W.write_stats_partition(hist, stats_path)
    return {"dates": days}


def train_job(spark: SparkSession, stats_path: str, model_path: str, report_path: str, label_threshold: float = 17000.0, min_hours: float = 10.0, **gbt) -> dict:
    """Training set from the stored statistics -> fit -> evaluate -> save the
    model, the evaluation report and the feature importances."""
    stats = read_table(spark, "streamer_statistics", stats_path)
    result = train(training_set(stats, label_threshold, min_hours), **gbt)
    ev = evaluate(result["predictions"])
    save_model(result["model"], model_path)
    Fi.write_report(ev["report"], f"{report_path.rstrip('/')}/report")
    imp = feature_importance(result["model"])
    Fi.write_importance(spark, imp, f"{report_path.rstrip('/')}/importance")
    c1 = ev["class1"].first().asDict()
    auc = ev["roc_auc"].first()["roc_auc"]
    return {"class1": c1, "roc_auc": auc, "class_weight": result["class_weight"], "top_features": imp[:5]}


def score_job(spark: SparkSession, model, input_csv: str, output_path: str | None = None, top: int = 10) -> tuple[str, DataFrame]:
    """Batch scoring of a CSV; returns the output path and the top rows (K4)."""
    df = Fi.read_scoring_csv(spark, input_csv)
    scored = score(model, df)
    out = output_path or Fi.default_output_path(input_csv)
    Fi.write_scores_csv(scored, out)
    return out, scored.limit(top)


def discovery_job(
    tables: DomainTables, listing: DataFrame, profiles: DataFrame, lo: int, hi: int, limit: int, now, dry_run: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Discovery over a listing landing table: per category the first ``limit``
    untracked streams in the viewer range that have a profile.  Returns the new
    entity rows (to append) and the per-category summary."""
    validate_range(lo, hi, limit)
    tracked = tables.streamers.select(F.col("streamer_id").alias("user_id")).withColumn("_tracked", F.lit(True))
    prof = profiles.select(F.col("streamer_id").alias("user_id"), "username", "display_name").withColumn("_profile", F.lit(True))
    flagged = listing.join(tracked, "user_id", "left").join(prof, "user_id", "left")
    # a stream listed more than once counts once, at its first place in the category
    flagged = W.first_per_key(flagged, ["game_id", "user_id"], ["listing_pos"])
    in_range = F.col("viewer_count").between(lo, hi)
    is_tracked = F.lit(False) if dry_run else F.coalesce("_tracked", F.lit(False))
    eligible = in_range & ~is_tracked & F.coalesce("_profile", F.lit(False))
    chosen, summary = K.quota(flagged, "game_id", "listing_pos", eligible, in_range & is_tracked, limit)
    # An entity chosen in several categories is one new row
    new_rows = W.first_per_key(
        chosen.select(F.col("user_id").alias("streamer_id"), "username", "display_name", F.lit(True).alias("is_active")), ["streamer_id"]
    ).withColumn("discovered_at", F.expr(f"TIMESTAMP_NTZ '{now}'"))
    return new_rows, summary
