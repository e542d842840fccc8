"""Spark session and cluster-facing settings.

Library code never creates a session behind the caller's back; these helpers are
for entry points (bench, tests, examples).  Everything scale-related lives here so
a cluster deployment changes one place.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every session should carry.  AQE re-plans joins at runtime: a side is
# broadcast only when its *measured* shuffle output is under the threshold, and
# falls back to sort-merge otherwise; skewed shuffle partitions are split.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "vantage",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    ``shuffle_partitions`` defaults to 2x the local cores; on a cluster set it so a
    shuffle partition holds ~128-256 MB (AQE coalesces small ones).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is None and master and master.split("[")[0] == "local":
        cores = master[master.find("[") + 1 : -1] if "[" in master else "1"
        n = (os.cpu_count() or 8) if cores == "*" else int(cores)
        shuffle_partitions = max(2, 2 * n)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once per application), so that Python
    workers import it wherever the driver was started.  Not needed where the package
    is installed on every node; ``spark-submit --py-files`` does the same."""
    sc = spark.sparkContext
    if any(f.endswith("/vantage.zip") for f in sc.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="vantage-ship-"), "vantage")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the deployment sets this to shared storage; a scratch folder is
    made only for a local master (tests), anything else without the setting is an
    error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vantage-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def reliable_checkpoint(df):
    """Materialize ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable checkpoints survive executor loss (the files live in the folder the
    cluster names in ``spark.checkpoint.dir``), unlike local checkpoints."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cluster_conf(shuffle_bytes: float, executors: int, cores_per_executor: int = 4, target_partition_mb: int = 256) -> dict:
    """Starting settings for a cluster run, sized from the expected shuffle volume.

    Shuffle partitions are sized to ~``target_partition_mb`` each (AQE coalesces
    small ones and splits skewed ones), but at least 2x the total cores so every
    core has work; file splits are sized the same way."""
    slots = executors * cores_per_executor
    parts = max(2 * slots, int(shuffle_bytes / (target_partition_mb * 1024 * 1024)) + 1)
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.files.maxPartitionBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * target_partition_mb}m",
        "spark.sql.parquet.aggregatePushdown": "true",
    }
