"""Training set, features and labels (M1-M2; the model itself is in ``vantage.plans.model``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import eps_ratio
from vantage.operators.filters import min_hours as _min_hours
from vantage.operators.windows import first_and_peak
from vantage.session import reliable_checkpoint

# The model's raw features (first statistics record) and label.
RAW_FEATURES = (
    "total_broadcasts",
    "total_broadcast_hours",
    "first_30d_avg_viewers",
    "first_30d_chat_rate",
    "first_30d_follower_gain",
    "first_30d_follower_velocity",
    "first_30d_unique_categories",
    "first_30d_follower_count",
)
FEATURES = RAW_FEATURES + ("tune_in_ratio",)
LABEL = "is_mega_streamer"

FIRST_RECORD_RENAMES = {
    "avg_concurrent_viewers": "first_30d_avg_viewers",
    "avg_chat_rate": "first_30d_chat_rate",
    "follower_gain_30d": "first_30d_follower_gain",
    "follower_velocity": "first_30d_follower_velocity",
    "unique_categories": "first_30d_unique_categories",
    "latest_follower_count": "first_30d_follower_count",
}


def add_tune_in_ratio(df: DataFrame, overwrite: bool = True) -> DataFrame:
    """M2 viewers per follower, ``avg / (followers + 1e-6)``; +-inf -> NULL.
    With ``overwrite=False`` an existing column is kept (M14)."""
    if not overwrite and "tune_in_ratio" in df.columns:
        return df
    return df.withColumn(
        "tune_in_ratio", eps_ratio(F.col("first_30d_avg_viewers"), F.col("first_30d_follower_count"))
    )


def training_set(stats: DataFrame, label_threshold: float = 17000.0, min_hours: float = 10.0) -> DataFrame:
    """M1 leakage-aware rows: features from each entity's first statistics
    record, label from its lifetime peak (the peak includes the first record,
    as the reference does), entities with more than ``min_hours`` hours only.
    Both come from one pass over the statistics."""
    cols = ["streamer_id", "calculation_date", "total_broadcasts", "total_broadcast_hours", *FIRST_RECORD_RENAMES]
    first = first_and_peak(stats.filter(F.col("streamer_id").isNotNull()), cols).drop("calculation_date")
    j = _min_hours(first.withColumnsRenamed(FIRST_RECORD_RENAMES), min_hours)
    out = j.select(
        "streamer_id",
        *[F.col(c).cast("double") if c not in ("total_broadcasts",) else F.col(c) for c in RAW_FEATURES],
        (F.col("peak_avg_viewers") >= F.lit(label_threshold)).cast("int").alias(LABEL),
    )
    # one row per entity, stored: every consumer, and the sampling of the sort, would compute the history anew
    return reliable_checkpoint(add_tune_in_ratio(out)).orderBy("streamer_id")
