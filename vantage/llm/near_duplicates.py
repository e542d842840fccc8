"""MinHash near-duplicates by a multi-index Hamming join.

A document is its set of 5-word shingles; its signature has 50 MinHash symbols of 16
bits.  Documents with equal sets form one node.  The signature is cut into 10 chunks
of 5 symbols.  By pigeonhole, two signatures that differ in at most 19 symbols agree
on some chunk but for at most one symbol, so for every chunk the five patterns with
one symbol left out are enumerated as bucket keys, and every such pair shares a
bucket.  (Two sets of similarity 0.75 share no bucket with probability below 5e-5.)

Buckets are never expanded into all pairs.  First every member is compared with the
smallest member of its bucket and the components of the confirmed links are taken.
Only buckets that still hold several components are compared further: their members
are dealt in blocks, signatures are compared in numpy within pairs of blocks, and
pairs of different components under the signature distance are confirmed, each once.
A second, finer sketch (the first hash of each of 512 ranges) spares most of those
whose similarity lies somewhat below the threshold.  Links inside a component cannot
change it, so no link is lost.  Every link is confirmed on the full shingle sets.

Defined results: null, empty or blank text has no shingles and is linked with
nothing; fewer than five words are one shingle; repeated rows have equal sets; rows
with a null ``doc_id`` take part, but do not name a component (it is null if none of
its rows has an id, and such rows are kept); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stash
from vantage.llm.components import connected_components

WORDS = 5
PERCENT = 75
CHUNKS, WIDTH = 10, 5
SYMBOLS = CHUNKS * WIDTH
# Least number of equal symbols: 5 standard deviations under what similarity 0.75 gives.
MIN_EQUAL = 22
BLOCK = 512
BINS = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MULTIPLIERS = np.random.default_rng(20).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = np.random.default_rng(21).integers(0, 2**63, SYMBOLS, dtype=np.uint64)
PLACES = np.random.default_rng(22).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Shingle sets as sorted distinct 64-bit hashes; word hashes are remembered up to a
    bounded number of words."""

    def __init__(self, remembered: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def shingles(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode().translate(LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < WORDS:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.array([known[w] for w in words], np.uint64)
        n = len(hashes) - WORDS + 1
        out = np.zeros(n, np.uint64)
        for k in range(WORDS):
            out += hashes[k : k + n] * PLACES[k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def signature(shingles: np.ndarray, step: int = 4096) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), step):
        part = shingles[None, i : i + step] * MULTIPLIERS[:, None]
        part += OFFSETS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(48)).astype(np.int32)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text), n (shingles), h1, h2 (a hash of the set), sig."""

    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            sizes, firsts, seconds, sigs = [], [], [], []
            for text in batch.column("text"):
                s = shingler.shingles(text.as_py())
                key = xxhash.xxh128_intdigest(s.tobytes())
                sizes.append(len(s))
                firsts.append((key >> 64) - 2**63)
                seconds.append(key % 2**64 - 2**63)
                sigs.append(signature(s) if len(s) else np.zeros(SYMBOLS, np.int32))
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int32)
            offsets = np.arange(0, len(flat) + 1, SYMBOLS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tkey"),
                    pa.array(sizes, pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.array(seconds, pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                names=["doc_id", "tkey", "n", "h1", "h2", "sig"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).mapInArrow(
        run, f"doc_id {kind}, tkey long, n long, h1 long, h2 long, sig array<int>"
    )


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of BINS ranges of the hash a byte of its first member, 0 for none."""
    out = np.zeros(BINS, np.uint8)
    place = (shingles >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    out[place[first]] = shingles[first] % np.uint64(255) + np.uint64(1)
    return out


def sketches_agree(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of these sketches and sizes can reach the similarity: the share of
    equal bins may be five standard deviations below it.  The bins hold a sample of
    the union without repeats, which makes the deviation small for small sets."""
    used = np.maximum(((others > 0) | (one > 0)).sum(axis=1), 1)
    equal = ((others == one) & (one > 0)).sum(axis=1)
    share = PERCENT / 100
    union = (sizes + size) / (1 + share)
    spread = np.sqrt(share * (1 - share) / used * np.clip(1 - used / union, 0, 1))
    return equal >= used * (share - 5 * spread) - 2


def shingle_sets(texts: DataFrame) -> DataFrame:
    """node, its shingle hashes and their sketch, from rows (node, text)."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                    pa.array([sketch(x).tobytes() for x in sets], pa.binary()),
                ],
                names=["node", "shingles", "sketch"],
            )

    return texts.mapInArrow(run, "node long, shingles array<long>, sketch binary")


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """node, pattern (0 to 49) and bucket key of every chunk with one symbol left out."""
    sig = F.col("sig")
    keys = [
        F.struct(
            F.lit(c * WIDTH + d).alias("pattern"),
            F.xxhash64(F.lit(c * WIDTH + d), *(sig[c * WIDTH + k] for k in range(WIDTH) if k != d)).alias("key"),
        )
        for c in range(CHUNKS)
        for d in range(WIDTH)
    ]
    return nodes.select("node", F.explode(F.array(*keys)).alias("k")).select("node", "k.pattern", "k.key")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_us"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("_vs"))
    both = F.size(F.array_intersect("_us", "_vs"))
    joined = pairs.join(right, "v").join(left, "u").withColumn("_both", both)
    return joined.where(100 * F.col("_both") >= PERCENT * (F.size("_us") + F.size("_vs") - F.col("_both"))).select("u", "v")


def near_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures agree on MIN_EQUAL symbols at least."""
    us = nodes.select(F.col("node").alias("u"), F.col("sig").alias("_us"))
    vs = nodes.select(F.col("node").alias("v"), F.col("sig").alias("_vs"))
    same = F.size(F.filter(F.zip_with("_us", "_vs", lambda a, b: a == b), lambda x: x))
    return pairs.join(vs, "v").join(us, "u").where(same >= MIN_EQUAL).select("u", "v")


def compare_cell(sig, fine, size, block, label, pattern: int, one: bool) -> tuple[list[int], list[int]]:
    """Index pairs of a cell that differ in label, agree on MIN_EQUAL symbols and on the
    sketch, and have ``pattern`` as the first they share; ``one``: a block with itself."""
    first, second = [], []
    left = np.arange(len(sig)) if one else np.flatnonzero(block == block.min())
    other = None if one else np.flatnonzero(block != block.min())
    for i in left:
        cand = np.arange(i + 1, len(sig)) if one else other
        cand = cand[label[cand] != label[i]]
        if not len(cand):
            continue
        same = sig[cand] == sig[i]
        ok = same.sum(axis=1) >= MIN_EQUAL
        cand, same = cand[ok], same[ok].reshape(-1, CHUNKS, WIDTH)
        if not len(cand):
            continue
        near = same.sum(axis=2) >= WIDTH - 1
        chunk = near.argmax(axis=1)
        drop = (~same[np.arange(len(cand)), chunk]).argmax(axis=1)
        cand = cand[near.any(axis=1) & (chunk * WIDTH + drop == pattern)]
        cand = cand[sketches_agree(fine[i], fine[cand], size[i], size[cand])]
        first.extend([i] * len(cand))
        second.extend(cand.tolist())
    return first, second


def cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components from rows (key, pattern, size, node,
    component, sig, n, sketch) of buckets that hold several components."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    cells = (
        members.withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "pattern", "b", "node", "component", "n", "sig", "sketch")
    )
    n = cells.sparkSession.conf.get("spark.sql.shuffle.partitions")
    cells = cells.repartition(int(n), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        def pairs(rows):
            keys, i, j, pattern, block, node, label, size, sig, fine = rows
            u, v = compare_cell(sig, fine, size, block, label, int(pattern[0]), i[0] == j[0])
            return node[u], node[v]

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            rows.append(batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(-1, SYMBOLS))
            rows.append(np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint8).reshape(-1, BINS))
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cell = np.stack(rows[:3])
            edges = np.flatnonzero((np.diff(cell, axis=1) != 0).any(axis=0)) + 1
            edges = [0, *edges.tolist()]
            found = [pairs([x[a:b] for x in rows]) for a, b in zip(edges, edges[1:], strict=False)]
            held = [x[edges[-1] :] for x in rows]
            yield result(found)
        if held is not None:
            yield result([pairs(held)])

    def result(found):
        u = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        v = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    pairs = cells.mapInArrow(run, "u long, v long")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id and kept, one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = stash(describe(docs))
    # one node per distinct set; a set seen only without ids gets a number of its own
    nodes = stash(
        rows.where("n > 0")
        .groupBy("h1", "h2")
        .agg(
            F.min("doc_id").alias("rep"),
            F.min_by(F.struct("tkey", "sig"), "doc_id").alias("r"),
            F.first(F.struct("tkey", "sig")).alias("m"),
        )
        .select(
            "h1",
            "h2",
            "rep",
            F.coalesce(F.col("rep").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64("h1", "h2"), 1)).alias("node"),
            F.coalesce("r.tkey", "m.tkey").alias("tkey"),
            F.coalesce("r.sig", "m.sig").alias("sig"),
        )
    )
    keys = bucket_keys(nodes)
    shared = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = stash(keys.join(shared, "key"))
    involved = members.select("node").distinct()
    # full sets of the members only, one text each
    wanted = nodes.join(involved, "node").select("node", F.col("rep").alias("_rep"), F.col("tkey").alias("_tkey"))
    texts = docs.withColumn("_t", F.xxhash64("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("_t") == F.col("_tkey"))).select("node", "text")
    sets = stash(shingle_sets(texts).groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch")))

    stars = members.where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    stars = stash(near_enough(stars, nodes))
    links = stash(confirm(stars, sets))
    labels = stash(connected_components(links))

    member = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = stash(member.select("key", "pattern", "size", "node", "component"))
    open_keys = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    fine = stash(sets.select("node", F.size("shingles").alias("n"), "sketch").join(nodes.select("node", "sig"), "node"))
    rest = member.join(stash(open_keys.select("key")), "key", "left_semi").join(fine, "node")
    more = cross_pairs(rest).distinct().join(stars, ["u", "v"], "left_anti")
    links = links.unionByName(stash(confirm(stash(more), sets)))
    labels = connected_components(links)

    placed = nodes.select("h1", "h2", "node", "rep").join(labels, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    # stored, so that both sides of the join on a hot component can be split
    names = stash(placed.groupBy("component").agg(F.min("rep").alias("component_id")))
    placed = stash(placed.join(names, "component").select("h1", "h2", "component_id"))
    out = rows.select("doc_id", "tkey", F.col("n").alias("n_shingles"), "h1", "h2").join(placed, ["h1", "h2"], "left")
    cid = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.withColumn("component_id", cid)
    return out.select(
        "doc_id",
        "tkey",
        "n_shingles",
        "component_id",
        (F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (its smallest doc_id)."""
    cols = docs.columns
    kept = stash(classes(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_k")).distinct())
    once = docs.withColumn("_t", F.xxhash64("text")).dropDuplicates(["doc_id", "_t"])
    return once.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_k")), "left_semi").select(*cols)
