"""Vector codes: product quantisation in integers with a GNAT over the entries.

Every component x becomes floor(256 * x).  A vector is cut into ``PARTS`` equal
consecutive parts; each part position has a codebook of up to ``ENTRIES`` integer
entries, first the parts of the smallest vec_ids, then moved ``ROUNDS`` times to the
floored mean of the parts nearest to them.  A code is the list of the nearest entries.

The nearest entry is found in a geometric near-neighbour access tree per codebook:
split points store, for every child, the range of distances from the split point to
the child's entries.  A query's distance to a split point excludes a child when the
range lies strictly farther from it than the best entry so far.  Distances are square
roots of integers; they are compared as integers on a fixed grid, lower bounds rounded
down and upper bounds rounded up, so rounding never excludes a child that could hold a
nearer or an equally near entry.  Entries that are reached are compared by their exact
integer squared distances, ties to the lower index.

Spark deals out the vectors: every round is one pass of ``mapInArrow`` over the stored
integer vectors that emits, per task, partial sums of each used entry, and one
aggregation of them.  Only codebooks (at most 16 x 64 entries) reach the driver.

Defined results: a vector that is null or holds a null or non-finite component is
dropped, and so is one shorter or longer than the most frequent length (ties: the
longer), as components are missing; lengths that 16 does not divide are filled up with
zeros.  Components beyond ``bound`` after scaling (+-2^27 for 64 components) are held
there, as the error is a long.  A null vec_id comes last in the order of the first entries, equal ids are
ordered by their vectors; repeated rows are coded each; other columns are ignored; a
table without vectors gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stash

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
SPLITS = 8  # children of a tree node
LEAF = 4  # entries up to which a node is scanned
GRID = 4  # distances are counted in 1 / GRID


# --------------------------------------------------------------------- the tree


def root_down(d2: np.ndarray) -> np.ndarray:
    """floor(GRID * sqrt(d2)) for non-negative integers below 2^58."""
    x = d2 * (GRID * GRID)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def root_up(d2: np.ndarray) -> np.ndarray:
    """ceil(GRID * sqrt(d2))."""
    r = root_down(d2)
    return r + (r * r < d2 * (GRID * GRID))


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    diff = points - entry
    return np.einsum("ij,ij->i", diff, diff)


class Node:
    """``ids``: entries compared here (the split points, or all of a leaf).  ``low`` and
    ``high`` [i, j]: range of distances from split point i to the entries of child j."""

    def __init__(self, ids: np.ndarray, children: list[Node | None], low: np.ndarray, high: np.ndarray) -> None:
        self.ids, self.children, self.low, self.high = ids, children, low, high


def build_tree(entries: np.ndarray, ids: np.ndarray | None = None) -> Node:
    """The tree over ``entries`` (rows of integers)."""
    ids = np.arange(len(entries)) if ids is None else ids
    none = np.zeros((0, 0), np.int64)
    if len(ids) <= LEAF:
        return Node(ids, [], none, none)
    # split points far from each other: the first entry, then always the farthest one
    chosen, away = [0], squared(entries[ids], entries[ids[0]])
    while len(chosen) < min(SPLITS, len(ids)):
        away[chosen] = -1
        chosen.append(int(away.argmax()))
        away = np.minimum(away, squared(entries[ids], entries[ids[chosen[-1]]]))
    splits = ids[chosen]
    rest = np.delete(ids, chosen)
    far = np.stack([squared(entries[rest], entries[s]) for s in splits])
    home = far.argmin(axis=0)
    n = len(splits)
    children: list[Node | None] = []
    low, high = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    for j in range(n):
        mine = home == j
        children.append(build_tree(entries, rest[mine]) if mine.any() else None)
        if mine.any():
            low[:, j] = root_down(far[:, mine].min(axis=1))
            high[:, j] = root_up(far[:, mine].max(axis=1))
    return Node(splits, children, low, high)


class Search:
    """Nearest entries of a block of query rows: ``best`` (squared distance) and ``index``."""

    def __init__(self, entries: np.ndarray, tree: Node, queries: np.ndarray) -> None:
        self.entries, self.queries = entries, queries
        self.best = np.full(len(queries), np.iinfo(np.int64).max)
        self.index = np.full(len(queries), len(entries))
        self.compared = 0
        self._visit(tree, np.arange(len(queries)))

    def _compare(self, rows: np.ndarray, entry: int) -> np.ndarray:
        d2 = squared(self.queries[rows], self.entries[entry])
        better = (d2 < self.best[rows]) | ((d2 == self.best[rows]) & (entry < self.index[rows]))
        self.best[rows[better]] = d2[better]
        self.index[rows[better]] = entry
        self.compared += len(rows)
        return d2

    def _visit(self, node: Node, rows: np.ndarray) -> None:
        away = np.stack([self._compare(rows, e) for e in node.ids])
        if not node.children:
            return
        down, up = root_down(away), root_up(away)
        # no entry of child j is nearer than this, whichever split point tells it
        least = np.stack([np.maximum(node.low[:, j : j + 1] - up, down - node.high[:, j : j + 1]).max(axis=0) for j in range(len(node.ids))])
        near = away.argmin(axis=0)
        # every row first goes to the child of its nearest split point
        for first in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                turn = np.flatnonzero((near == j) == first)
                turn = turn[least[j, turn] <= root_up(self.best[rows[turn]])]
                if len(turn):
                    self._visit(child, rows[turn])


# -------------------------------------------------------------------- the passes


def bound(width: int) -> int:
    """Largest component for which squared distances of ``width`` components fit a long."""
    return 2 ** ((62 - max(width - 1, 0).bit_length()) // 2 - 1)


def integer_vectors(table: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and ``_v``, the integer components of every whole vector; stored."""
    x = table.select(*carry, F.col("embedding").cast("array<double>").alias("_x"))
    whole = F.col("_x").isNotNull() & F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = x.where(whole)
    usual = x.groupBy(F.size("_x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = usual["width"] if usual else 0
    filled = F.concat("_x", F.array_repeat(F.lit(0.0), -width % PARTS))
    most = F.lit(float(bound(width + -width % PARTS)))
    held = F.transform(filled, lambda c: F.floor(F.greatest(F.least(c * SCALE, most), -most)).cast("long"))
    return stash(x.where(F.size("_x") == width).select(*carry, held.alias("_v")))


def first_codebooks(vectors: DataFrame, order: str) -> np.ndarray:
    """[part, entry, position] of the ENTRIES smallest vectors by ``order``."""
    top = vectors.orderBy(F.col(order).asc_nulls_last(), "_v").select("_v").limit(ENTRIES).collect()
    rows = np.array([r["_v"] for r in top], np.int64)
    width = rows.shape[1] // PARTS if top else 0
    return rows.reshape(len(rows), PARTS, width).transpose(1, 0, 2)


def _blocks(batch: pa.RecordBatch, shape: tuple) -> np.ndarray:
    flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, PARTS, shape[2])


def moved_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each used entry is the floored mean of its parts."""
    shape = books.shape

    def run(batches):
        trees = [build_tree(b) for b in books]
        sums = np.zeros(shape, object)  # whole numbers of any size
        counts = np.zeros(shape[:2], np.int64)
        for batch in batches:
            block = _blocks(batch, shape)
            for p in range(PARTS):
                index = Search(books[p], trees[p], block[:, p]).index
                counts[p] += np.bincount(index, minlength=shape[1])
                part = np.zeros(shape[1:], np.int64)
                np.add.at(part, index, block[:, p])
                sums[p] += part
        used = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used[:, 0], pa.int32()),
                pa.array(used[:, 1], pa.int32()),
                pa.array([counts[p, e] for p, e in used], pa.int64()),
                pa.array([[str(s) for s in sums[p, e]] for p, e in used], pa.list_(pa.string())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    partial = vectors.select("_v").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    total = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(shape[2])]
    moved = books.copy()
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # a row per entry
        moved[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(shape[2])]
    return moved


def fit(vectors: DataFrame, order: str) -> np.ndarray:
    """Codebooks [part, entry, position] of stored integer vectors."""
    books = first_codebooks(vectors, order)
    if books.shape[1]:
        for _ in range(ROUNDS):
            books = moved_codebooks(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray, carry: list[str]) -> DataFrame:
    """``carry``, code (array of entry indexes by part) and error (squared distances)."""
    shape = books.shape

    def run(batches):
        trees = [build_tree(b) for b in books]
        for batch in batches:
            block = _blocks(batch, shape)
            found = [Search(books[p], trees[p], block[:, p]) for p in range(PARTS)]
            codes = np.stack([s.index for s in found], axis=1).astype(np.int32)
            error = np.sum([s.best for s in found], axis=0, dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            offsets = np.arange(0, codes.size + 1, PARTS, dtype=np.int32)
            made = [pa.ListArray.from_arrays(offsets, codes.reshape(-1)), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + made, names=[*carry, "code", "error"])

    kinds = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in carry]
    return vectors.mapInArrow(run, ", ".join([*kinds, "code array<int>", "error long"]))


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(table: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) per vector, and the codebooks.

    ``label_error`` is the error summed over equal labels, nulls together: partial sums
    in the tasks, then one row per label joined back."""
    vectors = integer_vectors(table, ["vec_id", "label"])
    books = fit(vectors, "vec_id")
    if not books.shape[1]:
        empty = table.sparkSession.createDataFrame([], vectors.drop("_v").schema)
        return empty.selectExpr("*", "CAST(NULL AS array<int>) AS code", "0L AS error", "0L AS label_error"), books
    coded = stash(encode(vectors, books, ["vec_id", "label"]))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books
