"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantage.session import ensure_checkpoint_dir

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Word characters of the two definitions in use (Java and Python regular expressions).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# bytes.translate table: lower-cases A-Z and turns every other separator into a
# space, so ``text.encode().translate(ALNUM_TABLE).split()`` yields the ALNUM_WORD
# words of a text as UTF-8 bytes (bytes from 0x80 up belong to words).
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir``
    and read it back: lineage is cut, executor loss costs nothing, columns prune,
    and the planner knows the real size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stash/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def with_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based rank of each row in a total order, without one task that
    sees all rows: range partitions, a rank in each, and offsets from one count
    per partition."""
    spark = df.sparkSession
    parts = stash(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    offsets, start = [], 0
    for r in sorted(parts.groupBy("_part").count().collect(), key=lambda r: r["_part"]):  # a row per partition
        offsets.append((r["_part"], start))
        start += r["count"]
    before = spark.createDataFrame(offsets, "_part int, _before long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        parts.withColumn("_own", own)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_own"))
        .drop("_part", "_own", "_before")
    )
