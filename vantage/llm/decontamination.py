"""Benchmark decontamination with an FM-index per training shard.

The words of the benchmark form an alphabet.  Each task packs documents into shards
of a bounded number of words, builds an FM-index over the shard (suffix order,
Burrows-Wheeler transform, wavelet ranks, sampled suffix positions), runs every test
window backwards through the ranks, locates the matching rows by walking to sampled
positions, and merges the located word ranges of a document into removal spans.

A word outside the alphabet cannot be part of an occurrence: it ends a run, and only
runs at least as long as the shortest window are indexed.  This loses no match.

The benchmark side is packed into blocks of at most ``BLOCK_WORDS`` words.  A block is
broadcast (its size is bounded by that parameter); with several blocks the documents
are annotated block by block, each pass stored in the shared folder.

Defined results: null or empty text has no words, no spans and is clean; a null
``item_id`` counts as the empty string; repeated items or windows count once per
item id; an empty benchmark leaves every document clean; repeated documents are
treated row by row; clashing input columns are replaced by the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantage.llm.common import ALNUM_TABLE, ALNUM_WORD, stash

WINDOW = 10
BLOCK_WORDS = 4_000_000
SHARD_WORDS = 1_000_000
SAMPLE = 16
SPANS = "array<struct<start:int,end:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(ALNUM_TABLE).split() if text else []


class Block:
    """Windows over a bounded part of the benchmark: alphabet, and for each window
    length the distinct windows with the item ids that hold them."""

    def __init__(self) -> None:
        self.alphabet: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], set[str]]] = {}
        self.n_words = 0

    def add(self, item: str, text: str | None, width: int) -> None:
        ids = [self.alphabet.setdefault(w, len(self.alphabet) + 1) for w in words(text)]
        self.n_words += len(ids)
        size = min(width, len(ids))
        for i in range(len(ids) - size + 1 if ids else 0):
            self.windows.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)

    def packed(self) -> tuple:
        by_length = [
            (size, np.array(list(found), np.int32), [sorted(x) for x in found.values()])
            for size, found in sorted(self.windows.items())
        ]
        return self.alphabet, by_length


def blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[tuple]:
    """Blocks of at most ``limit`` words (an item stays whole)."""
    block = Block()
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text")
    for item, text in rows.toLocalIterator():
        if block.n_words >= limit:
            yield block.packed()
            block = Block()
        block.add(item, text, width)
    yield block.packed()


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence whose last key occurs once, by prefix doubling in
    which only the suffixes that are still tied are sorted again."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, np.diff(key[order]) != 0]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    step = 1
    while True:
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            return order
        own = order[tied]
        after = own + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        sort = np.argsort(rank[own] * (n + 1) + second + 1, kind="stable")
        own, second = own[sort], second[sort]
        first = rank[own]
        order[tied] = own
        new[tied] = np.r_[True, (np.diff(first) != 0) | (np.diff(second) != 0)]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[tied]] = group[tied]
        step *= 2


class FMIndex:
    """FM-index of a symbol sequence; symbol 0 separates runs and is never searched."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        n = len(symbols)
        separators = symbols == 0
        # separators sort before all else, each different, so ties end with their run
        key = np.where(separators, np.cumsum(separators), symbols.astype(np.int64) + n)
        order = suffix_array(key)
        bwt = symbols[order - 1]
        bwt[order == 0] = 0
        self.bwt = bwt
        self.less = np.r_[0, np.cumsum(np.bincount(symbols, minlength=sigma + 1))]
        starts = np.r_[True, separators[:-1]]
        self.sampled = starts[order] | (order % SAMPLE == 0)
        self.position = order
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = bwt
        for bit in range(max(1, int(sigma).bit_length()) - 1, -1, -1):
            one = (row >> bit) & 1
            ones = np.r_[0, np.cumsum(one)].astype(np.int32)
            self.levels.append((bit, ones, n - int(ones[-1])))
            row = np.concatenate([row[one == 0], row[one == 1]])
        # where the rows that equal a symbol begin at the last level
        self.position = np.where(self.sampled, order, -1)

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each index."""
        low, high = np.zeros_like(upto), upto
        for bit, ones, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low1, high1 = ones[low], ones[high]
            low = np.where(one, zeros + low1, low - low1)
            high = np.where(one, zeros + high1, high - high1)
        return high - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position) of every occurrence of windows of one length."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.bwt), np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            c = windows[alive, j]
            low = self.less[c] + self.rank(c, low)
            high = self.less[c] + self.rank(c, high)
            on = low < high
            alive, low, high = alive[on], low[on], high[on]
        size = high - low
        which = np.repeat(alive, size)
        row = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]] if len(size) else low, size) + np.arange(size.sum())
        return which, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix rows; runs begin with a sampled position, so
        the walk never crosses a separator."""
        out = np.full(len(row), -1, np.int64)
        at = np.arange(len(row))
        steps = 0
        while len(row):
            known = self.sampled[row]
            out[at[known]] = self.position[row[known]] + steps
            row, at = row[~known], at[~known]
            c = self.bwt[row]
            row = self.less[c] + self.rank(c, row)
            steps += 1
        return out


def shard_matches(ids: list[np.ndarray], packed: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words, window) of every match in a shard of documents
    given as arrays of alphabet numbers (0: another word); windows are numbered
    through all lengths."""
    alphabet, by_length = packed
    none = np.zeros(0, np.int64)
    if not by_length:
        return none, none, none, none
    shortest = by_length[0][0]
    flat = np.concatenate([np.r_[x, 0] for x in ids]) if ids else np.zeros(0, np.int64)
    sizes = np.array([len(x) + 1 for x in ids], np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes)
    word = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    known = flat > 0
    edge = np.diff(np.r_[0, known.view(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_enough = end - begin >= shortest
    begin, end = begin[long_enough], end[long_enough]
    if not len(begin):
        return none, none, none, none
    # each run with the separator behind it
    length = end - begin + 1
    take = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
    index = FMIndex(flat[take].astype(np.int64), len(alphabet))
    found = []
    base = 0
    for size, windows, _ in by_length:
        which, at = index.search(windows)
        found.append((doc[take[at]], word[take[at]], np.full(len(at), size), which + base))
        base += len(windows)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merge_spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Per document the sorted union of word ranges."""
    spans: dict[int, list[tuple[int, int]]] = {}
    if not len(doc):
        return spans
    wide = int((start + size).max()) + 2
    low = np.unique(doc * wide + start)
    high = np.zeros(len(low), np.int64)
    np.maximum.at(high, np.searchsorted(low, doc * wide + start), doc * wide + start + size)
    high = np.maximum.accumulate(high)
    cut = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
    for a, b in zip(low[cut], high[np.r_[cut[1:] - 1, len(low) - 1]], strict=True):
        spans.setdefault(int(a // wide), []).append((int(a % wide), int(b - a // wide * wide)))
    return spans


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def annotate(docs: DataFrame, packed: tuple, carry: list[str], shard_words: int = SHARD_WORDS) -> DataFrame:
    """``carry`` columns with n_words, spans (merged word ranges, end exclusive) and
    items; spans and items that ``docs`` has already are joined with the new ones."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(packed)
    again = {"spans", "items"} <= set(docs.columns)
    kept = [f for f in docs.schema.fields if f.name in carry]
    schema = T.StructType([*kept, *T.StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>").fields])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        packed = shared.value
        number = packed[0].get
        owners = [x for _, _, items in packed[1] for x in items]

        def matches(ids):
            doc, start, size, window = shard_matches(ids, packed)
            items: dict[int, set[str]] = {}
            pairs = np.unique(np.stack([doc, window]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
            for d, w in pairs.T.tolist():
                items.setdefault(d, set()).update(owners[w])
            return merge_spans(doc, start, size), items

        for batch in batches:
            spans, items, counts, ids, held = {}, {}, [], [], 0
            first = 0
            texts = batch.column(batch.schema.get_field_index("text"))
            for i in range(batch.num_rows):
                found = words(texts[i].as_py())
                counts.append(len(found))
                ids.append(np.array(list(map(number, found, repeat(0))), np.int64))
                held += len(found)
                if held >= shard_words or i + 1 == batch.num_rows:
                    s, t = matches(ids)
                    spans.update({first + d: x for d, x in s.items()})
                    items.update({first + d: x for d, x in t.items()})
                    first, ids, held = i + 1, [], 0
            if again:
                old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
                for i, (s, t) in enumerate(old):
                    if s:
                        spans[i] = _union([(x["start"], x["end"]) for x in s] + spans.get(i, []))
                        items[i] = set(t) | items.get(i, set())
            n = range(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(batch.schema.get_field_index(f.name)) for f in kept),
                    pa.array(counts, pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in spans.get(i, ())] for i in n], span_type),
                    pa.array([sorted(items.get(i, ())) for i in n], pa.list_(pa.string())),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str] | None = None,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with n_words, n_hit, spans, items and
    contaminated."""
    docs = docs.drop("n_words", "spans", "items", "n_hit", "contaminated")
    carry = [c for c in docs.columns if carry is None or c in carry]
    todo = list(dict.fromkeys([*carry, "text"]))
    docs = docs.select(*todo)
    pending = None
    for packed in blocks(benchmark, window, block_words):
        if pending is not None:
            docs = stash(annotate(docs, pending, todo, shard_words).drop("n_words"))
        pending = packed
    out = annotate(docs, pending, carry, shard_words)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0)


def cut_spans(annotated: DataFrame) -> DataFrame:
    """Remove the words of ``spans`` from ``text`` with the space between them; a
    removed range leaves one space.  Clean texts stay byte for byte."""
    schema = annotated.schema

    def run(batches):
        import re

        word = re.compile(ALNUM_WORD)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if not spans:
                    continue
                at = [m.span() for m in word.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))]
                pieces, last = [], 0
                for s in spans:
                    pieces.append(texts[i][last : at[s["start"]][0]])
                    last = at[s["end"] - 1][1]
                texts[i] = " ".join(x.strip() for x in [*pieces, texts[i][last:]] if x.strip())
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return annotated.mapInArrow(run, schema)
