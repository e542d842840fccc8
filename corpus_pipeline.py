"""The corpus pipeline: stages over ``documents``, each written as Parquet and read
back as the input of the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``, the last adds the shard of each record."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.llm import decontamination, mixing, near_duplicates, quality_classifier, sharding
from vantage.llm.common import read_table
from vantage.session import ensure_checkpoint_dir

N_SHARDS = 8
MIN_SCORE = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality; the others go."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    clash = [c for c in docs.columns if c == "score"]
    scored = quality_classifier.score_documents(docs.withColumnsRenamed({c: f"_{c}" for c in clash}), model)
    kept = scored.where(F.col("score") >= MIN_SCORE).drop("score")
    return kept.withColumnsRenamed({f"_{c}": c for c in clash}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; a document with one goes as a whole,
    since what surrounds a leaked item tends to be about it."""
    names = ["n_words", "n_hit", "spans", "items", "contaminated"]
    clash = {c: f"_{c}" for c in docs.columns if c in names}
    found = decontamination.decontaminate(docs.withColumnsRenamed(clash), read_table(spark, sf_dir, "benchmark"))
    kept = found.where(~F.col("contaminated")).drop(*names)
    return kept.withColumnsRenamed({b: a for a, b in clash.items()}).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources meet their targets."""
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every record with its shard and its position in it."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES: list[tuple[str, Callable]] = [
    ("classify", classify),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

# The classifier, the mixing hash and the slot hash cannot be written in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
