"""Jaccard join of documents on word n-grams by a size-aware heavy-light join.

A document is its set of 3-word shingles (64-bit hashes); documents with equal sets are
one node.  Two nodes of s and t shingles link when they share at least
``needed(s, t)`` of them.  Small and large sets are joined in two ways:

* small sets enumerate their fixed-size subsets: for every number c of shingles that
  some partner could require, every subset of c shingles is a key.  Two small sets that
  link share the key of a common subset of ``needed(s, t)`` shingles;
* large sets scan inverted lists: every set is indexed under its first shingles in one
  order of all shingles, as many as it takes that two linked sets share one, and a
  large set meets every set in the lists of its own first shingles.

The boundary between small and large is chosen by cost from all rows: keys that the
subsets of each size would emit, against the lengths of the lists that sets of this
size would scan.  The order puts frequent shingles last, so passages that many
documents share are scanned only by sets that consist of them.

Every member of a list is first compared with one member of it, and the components of
the confirmed links are taken; links inside a component cannot change it, so none is
lost by leaving them out.  Lists that still hold several components go on.  Short ones
(up to ``SHORT``) give the pairs of members of different components, each pair once over
all lists.  Long ones are dealt in blocks; pairs of blocks compare members of different
components, and every member outside the largest component names its ``CLOSEST``
partners only, so what a list gives out grows with its members, not with their pairs.
Lists with a member that had more are compared again, with components taken anew, without
the pairs that were refuted and with ``WIDER`` times as many partners each round.

Before the full sets of a pair are fetched, odd sketches bound their difference from
below: a sketch holds the parity of the number of members in each class of hashes, and
every class whose parity differs holds a member of one set only.  The bound never
discards a link.  Every link is confirmed on the full sets.

Defined results: null, empty or blank text has no shingles and is linked with nothing;
one or two words are one shingle; repeated rows have equal sets; rows with a null
``doc_id`` take part, but do not name a component (it is null if none of its rows has an
id); texts of any length are read whole; other columns are ignored; an empty table gives
no rows.  Members of one long list that are in different components are compared in
numpy, block by block; the comparisons, not the rows, grow with the square of their number.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stash
from vantage.llm.components import connected_components

WORDS, PERCENT = 3, 90
SMALL_MAX = 64  # sizes up to which subsets are considered
FLUSH = 1_000_000  # shingles counted together when frequent ones are sought
SEEN = 4  # rows among those from which a shingle is reported
FREQUENT = 2**17  # at most so many shingles have a place at the end of the order
SHORT = 8  # members of a list whose pairs are given out: at most 3.5 pairs a member
BLOCK = 512
CLOSEST, WIDER = 4, 16
BROADCAST_ROWS = 2**19
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PLACES = np.random.default_rng(30).integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --------------------------------------------------------------- sizes and subsets


def needed(s: int, t: int) -> int:
    """Least number of common members of linked sets of s and t members."""
    return -(-PERCENT * (s + t) // (100 + PERCENT))


def first_members(s: int) -> int:
    """Members under which a set is indexed: one more than a partner may lack."""
    return s - -(-PERCENT * s // 100) + 1


def subset_sizes(s: int) -> list[int]:
    """Numbers of members that a set of s has in common with some other set it links to."""
    least, most = -(-PERCENT * s // 100), 100 * s // PERCENT
    found = ((t, needed(s, t)) for t in range(least, most + 1))
    return sorted({c for t, c in found if c <= min(s, t) and not c == s == t})


def subset_count(s: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s))


# Sets under this size link with equal ones only.
LEAST = next(s for s in itertools.count(1) if subset_sizes(s))


@functools.lru_cache(maxsize=None)
def _left_out(s: int, c: int) -> np.ndarray:
    rows = list(itertools.combinations(range(s), s - c))
    return np.array(rows, np.int64).reshape(len(rows), s - c)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def subset_keys(members: np.ndarray) -> np.ndarray:
    """A key per subset that some partner could require: a hash of a sum over it."""
    m = mix(members + np.uint64(0x9E3779B97F4A7C15))
    total = m.sum(dtype=np.uint64)
    keys = []
    for c in subset_sizes(len(members)):
        keys.append(mix(total - m[_left_out(len(members), c)].sum(axis=1, dtype=np.uint64) + np.uint64(c)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- sets and sketches


class Shingles:
    """Sets as ascending 64-bit hashes; hashes of words are remembered up to a number."""

    def __init__(self, remembered: int = 200_000) -> None:
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def __call__(self, text: str | None) -> np.ndarray:
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
        return np.unique(mix(sum(hashes[k : k + n] * PLACES[k] for k in range(WORDS))))


def sketch(members: np.ndarray) -> np.ndarray:
    """A bit per class of hashes, one to two classes a member: the parity of its members."""
    classes = max(64, 1 << len(members).bit_length())
    at = (members & np.uint64(classes - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=classes) & 1, bitorder="little")


def fold(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (last axis) of ``width`` bytes: classes that agree in their low bits join."""
    while sketches.shape[-1] > width:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Classes in which sketches of one width (last axis) differ."""
    return np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)


def may_link(s, t, differing):
    """Whether sets of s and t members can link if at least so many are not common."""
    return (100 + PERCENT) * differing <= (100 - PERCENT) * (s + t)


def sizes_link(s, t):
    return 100 * np.minimum(s, t) >= PERCENT * np.maximum(s, t)


# ------------------------------------------------------------------ the shingle order


def shingle_order(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (ascending) and their places in the order, rarest first.
    A shingle counts as frequent by what tasks see in runs of rows; any order is right,
    a better one makes shorter lists.  At most ``FREQUENT`` reach the driver."""

    def run(batches):
        def report(held):
            found, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= SEEN
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

        of, held, size = Shingles(), [], 0
        for batch in batches:
            for text in batch.column("text"):
                held.append(of(text.as_py()))
                size += len(held[-1])
                if size >= FLUSH:
                    yield report(held)
                    held, size = [], 0
        if held:
            yield report(held)

    seen = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    seen = stash(seen.withColumn("level", F.floor(F.log2(F.col("n").cast("double"))).cast("int")))
    kept, least = 0, 63
    for r in sorted(seen.groupBy("level").count().collect(), reverse=True):  # a row per power of two
        kept += r["count"]
        if kept > FREQUENT:
            break
        least = r["level"]
    table = seen.where(F.col("level") >= least).orderBy("n", "shingle").select("shingle").toArrow()
    frequent = table.column("shingle").to_numpy().view(np.uint64)
    place = np.argsort(frequent)
    return frequent[place], place + 1


def in_order(members: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Members by place in the order, those that are not frequent first."""
    if not len(frequent):
        return members
    at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
    place = np.where(frequent[at] == members, places[at], 0)
    return members[np.argsort(place, kind="stable")]


# ------------------------------------------------------------------------ the join


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (a hash of the text), n, h1, h2 (a hash of the set), first (the
    members it is indexed under), whole (all members of a set of up to SMALL_MAX), sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(shingle_order(docs))

    def run(batches):
        import xxhash

        of = Shingles()
        frequent, places = sent.value
        lists = lambda x: pa.array([None if m is None else m.view(np.int64) for m in x], pa.list_(pa.int64()))
        for batch in batches:
            sizes, highs, lows, firsts, wholes, sketches = [], [], [], [], [], []
            for text in batch.column("text"):
                m = of(text.as_py())
                key = xxhash.xxh128_intdigest(m.tobytes())
                sizes.append(len(m))
                highs.append((key >> 64) - 2**63)
                lows.append(key % 2**64 - 2**63)
                firsts.append(in_order(m, frequent, places)[: first_members(len(m))] if len(m) else m)
                wholes.append(m if len(m) <= SMALL_MAX else None)
                sketches.append(sketch(m).tobytes())
            made = [pa.array(x, pa.int64()) for x in (sizes, highs, lows)]
            made += [lists(firsts), lists(wholes), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), *made],
                names=["doc_id", "tkey", "n", "h1", "h2", "first", "whole", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = "n long, h1 long, h2 long, first array<long>, whole array<long>, sketch binary"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).mapInArrow(run, f"doc_id {kind}, tkey long, {made}")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """One numbered node per distinct set; rep: its smallest doc_id."""
    made = F.struct("tkey", "n", "first", "whole", "sketch")
    nodes = rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.min_by("tkey", "doc_id").alias("_t"), F.first(made).alias("r")
    )
    return stash(
        nodes.select(
            F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep", "r.*", F.coalesce("_t", "r.tkey").alias("_k")
        ).drop("tkey").withColumnRenamed("_k", "tkey")
    )


def lists(postings: DataFrame) -> DataFrame:
    """The postings (key, node, n) of lists with two members or more, with size, hub (the
    member that all are compared with first) and largest (size of the largest set);
    one exchange serves the counts and the rows; stored."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select("key", "node", "n").repartition(parts, "key")
    found = dealt.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub"), F.max("n").alias("largest"))
    return stash(dealt.join(found.where("size > 1"), "key"))


def choose_boundary(nodes: DataFrame, listed: DataFrame) -> int:
    """The size up to which sets are small: the least sum of subset keys of small sets
    and scanned list entries of large ones, from the counts of every size."""
    count = {r["n"]: r["count"] for r in nodes.where(F.col("n") <= SMALL_MAX).groupBy("n").count().collect()}
    scans = listed.where(F.col("n") <= SMALL_MAX).groupBy("n").agg(F.sum("size").alias("entries"))
    scan = {r["n"]: r["entries"] for r in scans.collect()}
    best, boundary, keys = None, 0, 0
    for s in range(LEAST - 1, SMALL_MAX + 1):
        keys += subset_count(s) * count.get(s, 0)
        cost = keys + sum(v for n, v in scan.items() if n > s)
        if best is None or cost < best:
            best, boundary = cost, s
    return boundary


def subset_postings(nodes: DataFrame, boundary: int) -> DataFrame:
    """node, n and key of every subset of the sets of up to ``boundary`` members."""

    def run(batches):
        for batch in batches:
            sets = [np.array(x.as_py(), np.int64).view(np.uint64) for x in batch.column("whole")]
            for k, members in enumerate(sets):
                keys = subset_keys(np.sort(members))
                of = np.full(len(keys), batch.column("node")[k].as_py(), np.int64)
                n = np.full(len(keys), len(members), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(n), pa.array(keys.view(np.int64))], names=["node", "n", "key"])

    return nodes.where(F.col("n") <= boundary).select("node", "whole").mapInArrow(run, "node long, n long, key long")


def sketched(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches allow a link."""
    us = slim.select(F.col("node").alias("u"), F.col("n").alias("un"), F.col("sketch").alias("us"))
    vs = slim.select(F.col("node").alias("v"), F.col("n").alias("vn"), F.col("sketch").alias("vs"))
    fits = 100 * F.least("un", "vn") >= PERCENT * F.greatest("un", "vn")

    def run(batches):
        for batch in batches:
            keep = []
            for s, t, a, b in zip(*(batch.column(c).to_pylist() for c in ("un", "vn", "us", "vs")), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                width = min(len(a), len(b))
                keep.append(may_link(s, t, apart(fold(a, width), fold(b, width))))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(us, "u").join(vs, "v").where(fits).select("u", "v", "un", "vn", "us", "vs")
    return joined.mapInArrow(run, "u long, v long")


def short_pairs(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of members of different components and fitting sizes from rows (key,
    node, component, n) of lists of up to SHORT members, each pair once."""
    each = F.struct("node", "component", "n")
    found = members.groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("m"))
    one, other = F.col("one"), F.col("other")
    pairs = found.select("m", F.posexplode("m").alias("k", "one")).select("one", F.explode(F.slice("m", F.col("k") + 2, SHORT)).alias("other"))
    fits = 100 * F.least(one["n"], other["n"]) >= PERCENT * F.greatest(one["n"], other["n"])
    return pairs.where(fits & (one["component"] != other["component"])).select(one["node"].alias("u"), other["node"].alias("v")).distinct()


class Cell:
    """Members of a long list from one or two of its blocks; refuted: for each member the
    nodes that it does not link to; closest: how many partners a member names."""

    def __init__(self, node, block, label, size, sketches, refuted, closest: int = CLOSEST) -> None:
        self.node, self.block, self.label, self.size, self.refuted = node, block, label, size, refuted
        self.closest = closest
        self.width = np.array([len(s) for s in sketches])
        self.rows = {w: np.flatnonzero(self.width == w) for w in np.unique(self.width).tolist()}
        self.table = {(w, w): np.stack([np.frombuffer(sketches[i], np.uint8) for i in rows]) for w, rows in self.rows.items()}

    def _folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.table:
            self.table[width, to] = fold(self.table[width, width], to)
        return self.table[width, to]

    def _near(self, i: int, fit: np.ndarray) -> np.ndarray:
        """The members ``fit`` that may link to member i, the closest first."""
        found, far = [], []
        own = int(self.width[i])
        for width, rows in self.rows.items():
            asked = np.flatnonzero(fit[rows])
            if len(asked):
                to = min(width, own)
                mine = self._folded(own, to)[np.searchsorted(self.rows[own], i)]
                distance = apart(self._folded(width, to)[asked], mine)
                ok = may_link(self.size[rows[asked]], self.size[i], distance)
                found.append(rows[asked[ok]])
                far.append(distance[ok])
        if not found:
            return np.zeros(0, np.int64)
        found, far = np.concatenate(found), np.concatenate(far)
        if self.refuted[i] is not None and len(found):
            known = ~np.isin(self.node[found], self.refuted[i])
            found, far = found[known], far[known]
        return found[np.argsort(far, kind="stable")]

    def pairs(self, one: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of nodes of different components whose sizes and sketches allow a link, up
        to ``closest`` for each member outside the most frequent component, and whether
        it had more; ``one``: all members are of one block, else only pairs across the two."""
        labels, times = np.unique(self.label, return_counts=True)
        most = labels[times.argmax()]
        u, v, more = [], [], []
        # a pair of different components has a member outside the most frequent one
        for i in np.flatnonzero(self.label != most):
            fit = (self.label != self.label[i]) & sizes_link(self.size, self.size[i])
            fit &= (self.label == most) | (np.arange(len(fit)) > i)
            if not one:
                fit &= self.block != self.block[i]
            near = self._near(i, fit)
            found = near[: self.closest]
            u.extend([self.node[i]] * len(found))
            v.extend(self.node[found].tolist())
            more.extend([len(near) > len(found)] * len(found))
        return np.array(u, np.int64), np.array(v, np.int64), np.array(more, bool)


def cross_pairs(members: DataFrame, closest: int) -> DataFrame:
    """Pairs (key, u, v, more) of different components from rows (key, size, node, component, n,
    sketch, refuted) of long lists that hold several components."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    cells = (
        members.withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "node", "b", "component", "n", "sketch", "refuted")
    )
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        def found(rows):
            pairs = [Cell(*(x[a:b] for x in rows[3:]), closest).pairs(rows[1][a] == rows[2][a]) for a, b in edges(rows)]
            u, v, more = (np.concatenate([p[k] for p in pairs]) for k in range(3))
            key = np.repeat([rows[0][a] for a, _ in edges(rows)], [len(p[0]) for p in pairs]).astype(np.int64)
            made = [pa.array(key), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(more)]
            return pa.RecordBatch.from_arrays(made, names=["key", "u", "v", "more"])

        def edges(rows):
            cut = (np.diff(np.stack(rows[:3]), axis=1) != 0).any(axis=0)
            ends = [0, *(np.flatnonzero(cut) + 1).tolist(), len(rows[0])]
            return list(itertools.pairwise(ends))

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            rows.append(np.array(batch.column(7).to_pylist(), object))
            refuted = np.empty(batch.num_rows, object)
            refuted[:] = [None if r is None else np.array(r) for r in batch.column(8).to_pylist()]
            rows.append(refuted)
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            last = edges(rows)[-1][0]  # the last cell may go on in the next batch
            if last:
                yield found([x[:last] for x in rows])
            held = [x[last:] for x in rows]
        if held is not None:
            yield found(held)

    return cells.mapInArrow(run, "key long, u long, v long, more boolean")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles, from one text of each node of ``wanted`` (node, rep, tkey)."""
    wanted = stash(wanted.select("node", F.col("rep").alias("_rep"), F.col("tkey").alias("_tkey")))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)  # 24 bytes a row

    def run(batches):
        of = Shingles()
        for batch in batches:
            sets = [of(t.as_py()).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"])

    texts = docs.select("doc_id", "text").withColumn("_t", F.xxhash64("text"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("_t") == F.col("_tkey"))).select("node", "text")
    return texts.mapInArrow(run, "node long, members array<long>").groupBy("node").agg(F.first("members").alias("members"))


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v), once each, with linked: whether their full sets link; stored."""
    pairs = stash(pairs.distinct())
    asked = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = stash(full_sets(docs, nodes.join(asked, "node", "left_semi")))
    us = sets.select(F.col("node").alias("u"), F.col("members").alias("um"))
    vs = sets.select(F.col("node").alias("v"), F.col("members").alias("vm"))
    both = F.size(F.array_intersect("um", "vm"))
    joined = pairs.join(vs, "v").join(us, "u").withColumn("both", both)
    linked = 100 * F.col("both") >= PERCENT * (F.size("um") + F.size("vm") - F.col("both"))
    return stash(joined.select("u", "v", linked.alias("linked")))


def with_components(member: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``member`` whose list holds several components, with the component; stored."""
    found = member.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = stash(found.select(*member.columns, "component"))
    several = found.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return found.join(stash(several.select("key")), "key", "left_semi")


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = stash(describe(docs))
    nodes = distinct_sets(rows)
    slim = nodes.select("node", "n", "sketch")
    indexed = lists(nodes.where(F.col("n") >= LEAST).select("node", "n", F.explode("first").alias("key")))
    boundary = choose_boundary(nodes, indexed)
    scanned = indexed.where((F.col("largest") > boundary) & (F.col("n") >= -(-PERCENT * (boundary + 1) // 100)))
    member = scanned.unionByName(lists(subset_postings(nodes, boundary))).select("key", "size", "hub", "node", "n")

    stars = member.where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    links = confirmed(docs, nodes, sketched(stars, slim)).where("linked").select("u", "v")
    labels = stash(connected_components(links))

    # lists of three and more that still hold several components
    rest = stash(with_components(member.where("size > 2").drop("hub"), labels))
    short = sketched(short_pairs(rest.where(F.col("size") <= SHORT)), slim)
    links = links.unionByName(confirmed(docs, nodes, short).where("linked").select("u", "v"))
    long = rest.where(F.col("size") > SHORT).select("key", "size", "node")
    refuted, closest = None, CLOSEST
    labels = stash(connected_components(links))
    while True:
        left = with_components(long, labels).join(slim, "node")
        none = F.lit(None).cast("array<long>").alias("refuted")
        left = left.select("*", none) if refuted is None else left.join(refuted_partners(refuted), "node", "left")
        named = stash(cross_pairs(left, closest))
        asked = confirmed(docs, nodes, named.select("u", "v"))
        linked = asked.where("linked").select("u", "v")
        if linked.limit(1).count():
            links = links.unionByName(linked)
            labels = stash(connected_components(links))
        again = stash(named.where("more").select("key").distinct())
        if not again.limit(1).count():
            break
        # in the other lists every pair that may link was named
        long = stash(long.join(again, "key", "left_semi"))
        missed = asked.where("not linked")
        refuted = missed if refuted is None else refuted.unionByName(missed)
        closest *= WIDER

    placed = nodes.select("h1", "h2", "node", "rep").join(labels, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    # stored, so that both sides of the join on a hot component can be split
    names = stash(placed.groupBy("component").agg(F.min("rep").alias("component_id")))
    placed = stash(placed.join(names, "component").select("h1", "h2", "component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2").join(placed, ["h1", "h2"], "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def refuted_partners(pairs: DataFrame) -> DataFrame:
    """node and the nodes that it was refuted to link to (they passed the sketch)."""
    both = pairs.select(F.col("u").alias("node"), "v").unionByName(pairs.select(F.col("v").alias("node"), F.col("u").alias("v")))
    return both.groupBy("node").agg(F.collect_list("v").alias("refuted"))
