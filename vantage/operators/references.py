"""Foreign keys as data, and deletes that follow all of them.

``REFERENCES`` declares every reference of the schema once.  ``delete_rows`` walks it
from the deleted keys: a cascading reference deletes the child rows and goes on with
their keys, a set-null reference clears the column of the rows that stay.  Every step is
an equi-join on a key, so nothing is collected and a table that nothing refers to is
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASCADE, SET_NULL = "cascade", "set null"


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    on_delete: str


# Primary keys and references of the schema.
KEYS = {
    "streamers": ["streamer_id"],
    "categories": ["category_id"],
    "broadcasts": ["broadcast_id"],
    "broadcast_snapshots": ["broadcast_id", "snapshot_timestamp"],
    "streamer_statistics": ["streamer_id", "calculation_date"],
}
REFERENCES = (
    Reference("broadcasts", "streamer_id", "streamers", CASCADE),
    Reference("broadcasts", "primary_category_id", "categories", SET_NULL),
    Reference("broadcast_snapshots", "broadcast_id", "broadcasts", CASCADE),
    Reference("broadcast_snapshots", "streamer_id", "streamers", CASCADE),
    Reference("broadcast_snapshots", "category_id", "categories", SET_NULL),
    Reference("streamer_statistics", "streamer_id", "streamers", CASCADE),
    Reference("streamer_statistics", "top_category_id", "categories", SET_NULL),
)


def _tables_in_order(start: str) -> list[str]:
    """``start`` and all tables that its deletes can reach, parents before children."""
    reached, todo = {start}, [start]
    while todo:
        parent = todo.pop()
        for r in REFERENCES:
            if r.parent == parent and r.child not in reached:
                reached.add(r.child)
                if r.on_delete == CASCADE:
                    todo.append(r.child)
    order: list[str] = []
    while len(order) < len(reached):
        ready = [t for t in KEYS if t in reached and t not in order and all(r.parent in order or r.parent not in reached for r in REFERENCES if r.child == t)]
        order += ready
    return order


def delete_rows(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Every table that the delete of ``ids`` (the key column of ``table``) can touch, all
    its rows with ``_deleted`` (boolean) and ``_nulled`` (the names of the columns whose
    reference is gone).  ``remaining`` takes the table after the delete from it."""
    marked: dict[str, DataFrame] = {}
    for name in _tables_in_order(table):
        df = tables[name]
        deleted, nulled = F.lit(False), []
        if name == table:
            key = KEYS[table][0]
            gone = ids.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct().withColumn("_own", F.lit(True))
            df = df.join(gone, df[key] == F.col("_key"), "left").drop("_key")
            deleted = F.coalesce("_own", F.lit(False))
        for k, r in enumerate(r for r in REFERENCES if r.child == name and r.parent in marked):
            parent_key = KEYS[r.parent][0]
            gone = marked[r.parent].where("_deleted").select(F.col(parent_key).alias("_key")).distinct().withColumn(f"_r{k}", F.lit(True))
            df = df.join(gone, F.col(r.column) == F.col("_key"), "left").drop("_key")
            hit = F.coalesce(f"_r{k}", F.lit(False))
            if r.on_delete == CASCADE:
                deleted = deleted | hit
            else:
                nulled.append(F.when(hit, F.lit(r.column)))
        lost = F.array_compact(F.array(*nulled)) if nulled else F.array().cast("array<string>")
        columns = tables[name].columns
        df = df.withColumns({"_deleted": deleted, "_nulled": lost})
        marked[name] = df.select(*columns, "_deleted", F.when(F.col("_deleted"), F.array().cast("array<string>")).otherwise(F.col("_nulled")).alias("_nulled"))
    return marked


def remaining(marked: DataFrame) -> DataFrame:
    """The table after the delete: rows that stay, cleared references as NULL."""
    columns = [c for c in marked.columns if c not in ("_deleted", "_nulled")]
    cleared = {r.column for r in REFERENCES if r.on_delete == SET_NULL}
    kept = marked.where("NOT _deleted")
    return kept.select(*[F.when(~F.array_contains("_nulled", c), F.col(c)).alias(c) if c in cleared else F.col(c) for c in columns])


def touched_keys(marked: dict[str, DataFrame]) -> DataFrame:
    """(table_name, effect, id, place): the key of every deleted row, and of every row
    and column whose reference was cleared; ``place`` is the second key column, if any."""
    out = None
    for name, df in marked.items():
        key = [F.col(KEYS[name][0]).cast("bigint").alias("id")]
        key.append((F.col(KEYS[name][1]).cast("string") if len(KEYS[name]) > 1 else F.lit(None).cast("string")).alias("place"))
        effects = F.when(F.col("_deleted"), F.array(F.lit("deleted"))).otherwise(F.col("_nulled"))
        rows = df.select(F.lit(name).alias("table_name"), F.explode(effects).alias("effect"), *key)
        out = rows if out is None else out.unionByName(rows)
    return out
