"""CSV / JSON inputs and outputs of the scoring and training jobs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.operators.ml import RAW_FEATURES

SCORING_SCHEMA = T.StructType(
    [T.StructField("username", T.StringType()), T.StructField("streamer_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW_FEATURES]
    + [T.StructField("tune_in_ratio", T.DoubleType())]
)


def read_scoring_csv(spark: SparkSession, path: str) -> DataFrame:
    """A9 scoring input with a header; the required feature columns must be
    present (a metadata check on the header, no data pass)."""
    head = spark.read.option("header", True).csv(path).columns
    missing = sorted(set(RAW_FEATURES) - set(head))
    if missing:
        raise ValueError(f"the file lacks {', '.join(missing)}")
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    types = {f.name: f.dataType for f in SCORING_SCHEMA.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def default_output_path(input_path: str) -> str:
    """A10 ``<input>_predictions`` next to the input."""
    root, ext = os.path.splitext(input_path.rstrip("/"))
    return f"{root}_predictions{ext or ''}"


def write_scores_csv(scored: DataFrame, path: str) -> None:
    """A10 ranked scores as CSV (sorted output, one header per part file)."""
    scored.orderBy(F.col("mega_streamer_score").desc()).write.mode("overwrite").option("header", True).csv(path)


def write_importance(spark: SparkSession, importances: list[tuple[str, float]], path: str) -> None:
    """A11 feature importances as CSV."""
    spark.createDataFrame(importances, "feature string, importance double").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """A12 evaluation report rows (long format) as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)
