"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Terms are word shapes (letters and digits collapsed, signs kept), word lengths and
repeats of the word before, hashed into a fixed number of columns.  Inverse document
frequencies are counted over all documents.  A bounded sample of labelled documents is
projected onto its leading singular vectors; the labelled vectors (at most
``2 * PER_CLASS`` rows of ``RANK`` numbers) are broadcast.  Every document's exact
cosine products with all of them are computed block by block, and the labels of the
``NEIGHBOURS`` nearest vote with weights that grow with similarity, corrected for
the sample's share of each class.

Labels of held-out documents (``crc32(doc_id) mod 3 = 1``) are never read; labels,
language, source and doc_id are no inputs of a score.

Defined results: null or empty text scores 0; a null ``doc_id`` or label is not
learnt from (a null doc_id is not held out); several labels of one document count as
their largest; without any label all scores are 1; an empty table gives no rows;
clashing input columns are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PER_CLASS = 1500
COLUMNS = 1024
RANK = 32
NEIGHBOURS = 15
SHARPNESS = 16
BLOCK = 1024
DIGITS = re.compile(rb"[0-9]+")
LOWER = re.compile(rb"(?:[a-z]|[\x80-\xff])+")
UPPER = re.compile(rb"[A-Z]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Terms:
    """Sparse term counts of texts; words are remembered up to a bounded number."""

    def __init__(self, remembered: int = 150_000) -> None:
        import xxhash

        self.number = lambda term: xxhash.xxh32_intdigest(term) % COLUMNS
        self.known: dict[bytes, int] = {}
        self.remembered = remembered
        self.lengths = np.array([self.number(b"length %d" % min(n, 20)) for n in range(21)])
        self.again = self.number(b"again")

    def _shape(self, word: bytes) -> int:
        # numbers of shape and length in one integer
        shape = LOWER.sub(b"x", UPPER.sub(b"X", DIGITS.sub(b"9", word)))
        return self.number(b"shape " + shape[:16]) * 32 + min(len(word), 20)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(columns, damped counts) of one text."""
        words = text.encode().split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._shape(w)
        codes = np.array([known[w] for w in words])
        row = np.bincount(codes // 32, minlength=COLUMNS)
        row += np.bincount(self.lengths[codes % 32], minlength=COLUMNS)
        row[self.again] += 2 * sum(a == b for a, b in zip(words, words[1:], strict=False))
        at = np.flatnonzero(row)
        return at, np.sqrt(row[at] / len(words))


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each term) over all rows; at most one row per term
    and task is shuffled."""

    def run(batches):
        terms = Terms()
        seen = np.zeros(COLUMNS + 1, np.int64)
        for batch in batches:
            seen[COLUMNS] += batch.num_rows
            for text in batch.column("text"):
                seen[terms.counts(text.as_py())[0]] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(COLUMNS + 1, np.int64)
    for r in got:
        out[r["term"]] = r["n"]
    return int(out[COLUMNS]), out[:COLUMNS]


class Model:
    """Projection of terms, and the labelled vectors with their labels and weights."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.idf, self.basis, self.vectors, self.labels, self.weights = idf, basis, vectors, labels, weights

    def project(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        wide = np.zeros((len(rows), COLUMNS), np.float32)
        for k, (at, n) in enumerate(rows):
            wide[k, at] = n * self.idf[at]
        out = wide @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def vote(self, latent: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(latent))
        close = latent @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-close, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(close, near, axis=1), 1e-6, 1.0).astype(np.float64) ** SHARPNESS * self.weights[near]
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rank: int = RANK) -> Model:
    """Fit on at most ``per_class`` labelled rows of either class, chosen by a hash of
    the doc_id; frequencies come from all of ``docs``."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = []
    for quality in (0, 1):
        one = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen += [(r["doc_id"], r["quality"]) for r in one.collect()]
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen, known.select("doc_id", "quality").schema)
    # at most 2 * per_class ids
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        terms = Terms()
        for batch in batches:
            rows = [terms.counts(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality"),
                    pa.array([a for a, _ in rows], pa.list_(pa.int64())),
                    pa.array([n for _, n in rows], pa.list_(pa.float64())),
                ],
                names=["doc_id", "quality", "at", "n"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema}
    vectors = texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, at array<long>, n array<double>")
    # repeated rows of a labelled document count once
    rows = vectors.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    total, seen = document_frequencies(docs)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    wide = np.zeros((len(rows), COLUMNS), np.float32)
    for k, r in enumerate(rows):
        wide[k, r["at"]] = np.array(r["n"]) * idf[r["at"]]
    _, axes = np.linalg.eigh((wide.T @ wide).astype(np.float64))
    basis = np.ascontiguousarray(axes[:, ::-1][:, :rank]).astype(np.float32)
    y = np.array([r["quality"] for r in rows], np.float64)
    weights = np.ones(len(rows))
    for quality, n in share.items():
        own = y == quality
        if own.any():
            weights[own] = n / own.sum()
    latent = wide @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    return Model(idf, basis, latent, y, weights)


def score_documents(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with score."""
    docs = docs.drop("score")
    carry = [c for c in docs.columns if carry is None or c in carry]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("score", T.DoubleType())])

    def run(batches):
        terms, model = Terms(), shared.value
        for batch in batches:
            scores = []
            for lo in range(0, batch.num_rows, BLOCK):
                rows = [terms.counts(t.as_py()) for t in batch.column("text")[lo : lo + BLOCK]]
                votes = model.vote(model.project(rows))
                scores.extend(v if len(at) else 0.0 for v, (at, _) in zip(votes.tolist(), rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(scores, pa.float64())], names=schema.names
            )

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
