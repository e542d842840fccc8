"""Sharding over fixed virtual slots.

Every record hashes into one of ``n_slots`` virtual slots.  Bytes and rows are
summed per slot, and a slot-to-shard map assigns whole slots to shards.  The map is
a small versioned table: growing or rebalancing edits the map and never rehashes
records, so only the records of the moved slots change shard.

Everything that reaches the driver has one row per virtual slot (``n_slots`` is a
parameter, so it is bounded); records are numbered within their slot and the
numbers are shifted by the rows of the earlier slots of the shard.

Defined results: null text counts as empty (size 1, CRC 0); rows with a null
``doc_id`` are spread by the CRC of their text; repeated rows get different
positions; an empty table gives no rows and a map over empty slots; input columns
that clash with an output column are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, records long"


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``docs`` with size, text_crc32 and vslot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.withColumn("size", (F.octet_length(text) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(text.cast("binary")))
        .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))
    )


def slot_loads(recs: DataFrame, n_slots: int = N_SLOTS) -> dict[int, tuple[int, int]]:
    """vslot -> (bytes, records); ``n_slots`` entries."""
    got = {
        r["vslot"]: (r["bytes"], r["records"])
        for r in recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("records")).collect()
    }
    return {s: got.get(s, (0, 0)) for s in range(n_slots)}


def build_map(loads: dict[int, tuple[int, int]], n_shards: int, version: int = 1) -> list[tuple]:
    """First map: slots by falling bytes, each to the lightest shard."""
    heap = [(0, k) for k in range(n_shards)]
    rows = []
    for slot, (size, n) in sorted(loads.items(), key=lambda x: (-x[1][0], x[0])):
        total, shard = heapq.heappop(heap)
        heapq.heappush(heap, (total + size, shard))
        rows.append((version, slot, shard, size, n))
    return sorted(rows, key=lambda r: r[1])


def rebalance(old: list[tuple], loads: dict[int, tuple[int, int]], n_shards: int, tolerance: float = 0.01) -> list[tuple]:
    """Next version of a map for new loads or another shard count.

    Slots of shards that no longer exist move first; then the heaviest shard gives
    its largest slot that narrows the gap to the lightest one, until the two differ
    by at most ``tolerance`` of the mean.  Every other slot stays where it was."""
    shard = {slot: s for _, slot, s, _, _ in old}
    total = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = [s for s in loads if shard.get(s, n_shards) >= n_shards]
    for slot, s in shard.items():
        if s < n_shards:
            total[s] += loads[slot][0]
            held[s].append(slot)
    for slot in sorted(homeless, key=lambda s: (-loads[s][0], s)):
        to = min(range(n_shards), key=lambda k: (total[k], k))
        shard[slot] = to
        total[to] += loads[slot][0]
        held[to].append(slot)
    mean = sum(total) / n_shards
    while True:
        high = max(range(n_shards), key=lambda k: (total[k], -k))
        low = min(range(n_shards), key=lambda k: (total[k], k))
        gap = total[high] - total[low]
        fit = [s for s in held[high] if 0 < loads[s][0] < gap]
        if gap <= tolerance * mean or not fit:
            break
        slot = max((s for s in fit if 2 * loads[s][0] <= gap), default=None, key=lambda s: (loads[s][0], -s))
        if slot is None:
            slot = min(fit, key=lambda s: (loads[s][0], s))
        held[high].remove(slot)
        held[low].append(slot)
        shard[slot] = low
        total[high] -= loads[slot][0]
        total[low] += loads[slot][0]
    version = 1 + max((r[0] for r in old), default=0)
    return [(version, slot, shard[slot], *loads[slot]) for slot in sorted(shard)]


def save_map(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Append a version to the stored map; earlier versions stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple]:
    """A stored version (default: the newest); ``n_slots`` rows."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return [
        tuple(r)
        for r in stored.where(F.col("version") == version)
        .select("version", "vslot", "shard", "bytes", "records")
        .orderBy("vslot")
        .collect()
    ]


def place(recs: DataFrame, slot_map: list[tuple]) -> DataFrame:
    """Add shard, slot (gapless position within the shard) and map_version.

    The order of records within a virtual slot is that of a hash of doc_id; one
    task sorts one virtual slot, never a whole shard."""
    spark = recs.sparkSession
    seen: dict[int, int] = {}
    rows = []
    for version, vslot, shard, _, n in slot_map:
        rows.append((vslot, shard, seen.get(shard, 0), version))
        seen[shard] = seen.get(shard, 0) + n
    table = spark.createDataFrame(rows, "vslot int, shard int, _before long, map_version int")
    order = [F.xxhash64("doc_id").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    recs = recs.drop("shard", "slot", "map_version", "_before")
    return (
        recs.withColumn("_own", F.row_number().over(Window.partitionBy("vslot").orderBy(*order)) - 1)
        .join(F.broadcast(table), "vslot")
        .withColumn("slot", (F.col("_before") + F.col("_own")).cast("long"))
        .drop("_own", "_before")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, vslot, shard, slot, law, grown_shard.

    ``map_path``: where versions of the map are stored.  If it holds one, it is
    rebalanced to the present loads and the new version is appended."""
    spark = docs.sparkSession
    recs = records(docs, n_slots)
    loads = slot_loads(recs, n_slots)
    if map_path and _exists(spark, map_path):
        slot_map = rebalance(load_map(spark, map_path), loads, n_shards)
    else:
        slot_map = build_map(loads, n_shards)
    if map_path:
        save_map(spark, slot_map, map_path)
    return place(recs, slot_map).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
