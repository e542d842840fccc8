"""Alignment of two tokenizers by merge-path partitioning of their token ends.

Every text is encoded as space + text by A (byte-level BPE, a ``tokenizers`` JSON file)
and as text by B (a ``sentencepiece`` model, which adds the space itself).  Both give
ascending byte offsets at which tokens end.  Merging the two lists yields the overlaps
of A and B tokens; where an A and a B token end together a group is cut, and the two
tokens that end there are linked.

The merge is partitioned by merge path: of the A x B grid of ends, every diagonal
``k * WORK`` is searched binarily for the point where the merge crosses it, which cuts
the merge into pieces of equal work that need nothing of each other, however long one
text is.  A piece emits its overlaps; an A end and its equal B end may fall on both
sides of a piece's border, and stitching closes that overlap.  Texts of a block are
merged as one pair of lists, so a task's pieces are equal over short and long texts.

How often a pair of ids is linked is counted over the whole corpus.  Each link then
needs its pair's count: the most frequent pairs (a table of at most ``HEAD`` rows, cut
at a power of two of the count) are broadcast, and links of all rarer pairs are joined
by a shuffle, where no key is frequent any more.

The vocabulary files are read on the driver and sent to the tasks (2 MB in all).

Defined results: a null or empty text has no tokens; neither has a text whose joined A
or B bytes differ from space + text (for example one that holds U+2581); special
tokens' strings are plain text; repeated rows and null ids are rows of their own; other
columns are not read; texts of any length are encoded whole, one at a time; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import stash

WORK = 8192  # ends merged by one piece
BLOCK_CHARS = 300_000  # texts merged together
HEAD = 2**18
# Fixed value: the pattern by which the byte-level vocabulary splits texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# ------------------------------------------------------------------- merge path


def diagonal_splits(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B ends before each diagonal 0, work, 2 work, ... of the merge
    (of equal ends A's comes first): one binary search per diagonal, all at once."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at, bt = a[np.minimum(mid, max(len(a) - 1, 0))], b[np.clip(d - 1 - mid, 0, max(len(b) - 1, 0))]
        right = open_ & (at <= bt)
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of one piece in order: number of A ends and of B ends of the piece before
    each, and whether an A and a B token end with it.  A B end equal to an A end of the
    piece closes that A end's overlap and opens none."""
    equal_at = np.searchsorted(a, b, "left")
    equal = equal_at < len(a)
    equal[equal] = a[equal_at[equal]] == b[equal]
    own = b[~equal]
    ends = np.concatenate([a, own])
    before_a = np.concatenate([np.arange(len(a)), np.searchsorted(a, own, "left")])
    before_b = np.concatenate([np.searchsorted(b, a, "left"), np.flatnonzero(~equal)])
    closed = np.zeros(len(ends), bool)
    closed[equal_at[equal]] = True
    order = np.argsort(ends, kind="stable")
    return before_a[order], before_b[order], closed[order]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of the tokens that end at ``a`` and ``b`` (both strictly ascending, equal
    last ends): index of the A token, of the B token, and whether both end with it."""
    i, j = diagonal_splits(a, b, work)
    pieces = []
    for p in range(len(i) - 1):
        at, bt, closed = merge_piece(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]])
        # stitching: the piece begins with the B end that equals the last A end before it
        if i[p] and j[p] < j[p + 1] and a[i[p] - 1] == b[j[p]]:
            pieces[-1][2][-1] = True
            at, bt, closed = at[1:], bt[1:], closed[1:]
        pieces.append((at + i[p], bt + j[p], closed))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


# ------------------------------------------------------------------ vocabularies


def _byte_alphabet() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves, the others as the
    characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Vocabulary A: ids of a text, and every token's bytes."""

    def __init__(self, spec: bytes) -> None:
        from tokenizers import Tokenizer

        parts = json.loads(spec)
        alphabet = _byte_alphabet()
        self.tokens = {i: bytes(alphabet[c] for c in t) for t, i in parts["model"]["vocab"].items()}
        # special tokens are never produced (their strings are plain text)
        self.size = max([*self.tokens, *(t["id"] for t in parts["added_tokens"])]) + 1
        if self._by_rank(parts):
            import tiktoken

            ranks = {t: i for i, t in self.tokens.items()}
            found = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = found.encode_ordinary
        else:
            whole = Tokenizer.from_str(spec.decode())
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _by_rank(parts: dict) -> bool:
        """Whether the merges come in the order of their tokens' ids and nothing else
        changes the text: then merging by rank gives the same tokens, much faster."""
        model, split = parts["model"], parts["pre_tokenizer"]
        plain = not parts["normalizer"] and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        plain = plain and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ids = [model["vocab"]["".join(m)] for m in pairs]
        return bool(plain and ids == list(range(len(model["vocab"]) - len(ids), len(model["vocab"]))))


class Pieces:
    """Vocabulary B: ids of a text, and every token's bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = len(self.model)
        self.tokens = {i: self._bytes(self.model.id_to_piece(i)) for i in range(self.size)}

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@functools.lru_cache(maxsize=1)  # a worker's tasks share one
def vocabularies(a: bytes, b: bytes) -> Aligner:
    return Aligner(ByteLevel(a), Pieces(b))


class Aligner:
    """Aligns blocks of texts."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.a_bytes = [a.tokens.get(i, b"") for i in range(a.size)]
        self.b_bytes = [b.tokens[i] for i in range(b.size)]
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        names = [f"{i}{mark}" for i in range(a.size) for mark in ",|"]
        self.written = names + [f"{i}{mark}" for i in range(b.size) for mark in ",;"]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and B, none unless both give back exactly space + text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = " " + text
        a, b = self.a.encode(whole), self.b.encode(text)
        wanted = whole.encode()
        at, bt = self.a_bytes, self.b_bytes
        if b"".join([at[i] for i in a]) != wanted or b"".join([bt[i] for i in b]) != wanted:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def block(self, texts: list[str | None]) -> tuple[list, list, list[str], list[np.ndarray]]:
        """Numbers of A and of B tokens, groups as text and linked pairs of every text."""
        found = [self.tokens(t) for t in texts]
        n_a, n_b = [len(a) for a, _ in found], [len(b) for _, b in found]
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        at, bt, closed = overlaps(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]))
        last_a, last_b = at[closed], bt[closed]  # the tokens that end with each group
        pairs = a[last_a] * self.b.size + b[last_b]
        # groups in writing order: a group's A tokens, then its B tokens
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        b_before = np.append(0, last_b + 1)
        written = np.zeros(len(a) + len(b), np.int64)
        ends = np.zeros(len(a), bool)
        ends[last_a] = True
        written[np.arange(len(a)) + b_before[group_a]] = a * 2 + ends
        ends = np.zeros(len(b), bool)
        ends[last_b] = True
        written[np.arange(len(b)) + (last_a + 1)[group_b]] = self.a.size * 2 + b * 2 + ends
        groups, links, name = [], [], self.written
        a_to, b_to = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        link_to = np.searchsorted(last_a, a_to)
        for k in range(len(texts)):
            text = "".join([name[w] for w in written[a_to[k] + b_to[k] : a_to[k + 1] + b_to[k + 1]].tolist()])
            groups.append(text[:-1])
            links.append(pairs[link_to[k] : link_to[k + 1]])
        return n_a, n_b, groups, links


# ------------------------------------------------------------------------- Spark


def align(docs: DataFrame, a_path: str, b_path: str, carry: list[str]) -> DataFrame:
    """``carry``, n_a, n_b, groups (``a1,a2|b1;a3|b2,b3``) and links (the linked id
    pairs in order, as A id * size of B + B id) of every row."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        aligner = vocabularies(*sent.value)
        for batch in batches:
            texts, start, held = [], 0, 0
            for k, text in enumerate(batch.column("_text")):
                texts.append(text.as_py())
                held += len(texts[-1] or "")
                if held >= BLOCK_CHARS or k == batch.num_rows - 1:
                    n_a, n_b, groups, links = aligner.block(texts)
                    offsets = np.append(0, np.cumsum([len(x) for x in links])).astype(np.int32)
                    flat = np.concatenate(links)
                    made = [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string())]
                    made.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())))
                    carried = [batch.column(c).slice(start, len(texts)) for c in carry]
                    yield pa.RecordBatch.from_arrays(carried + made, names=[*carry, "n_a", "n_b", "groups", "links"])
                    texts, start, held = [], k + 1, 0

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    made = ["n_a long", "n_b long", "groups string", "links array<long>"]
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kinds, *made]))


def link_counts(links: DataFrame, b_size: int) -> DataFrame:
    """pair, n (its links in all rows) and best (whether n is the highest of its B id)
    from stored rows with ``links``; stored."""
    pairs = stash(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    b = F.pmod(F.col("pair"), F.lit(b_size))
    top = F.broadcast(pairs.groupBy(b.alias("_b")).agg(F.max("n").alias("_top")))  # at most one row per B id
    return stash(pairs.join(top, b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_top")).cast("int").alias("best")))


def head_bound(counts: DataFrame, head: int = HEAD) -> int:
    """The smallest power of two that at most ``head`` pairs' counts reach."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    kept, bound = 0, 2**62
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # a row per power
        kept += r["count"]
        if kept > head:
            break
        bound = 2 ** r["level"]
    return bound


def link_sums(links: DataFrame, counts: DataFrame, row: str, head: int = HEAD) -> DataFrame:
    """row, n_best and count_sum over the links of every row that has links."""
    bound = head_bound(counts, head)
    known = F.broadcast(counts.where(F.col("n") >= bound))
    rare = counts.where(F.col("n") < bound)
    each = links.select(row, F.explode("links").alias("pair"))
    total = lambda x: x.groupBy(row).agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    often = total(each.join(known, "pair"))
    seldom = total(each.join(known.select("pair"), "pair", "left_anti").join(rare, "pair"))
    both = often.unionByName(seldom)
    return both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 per row."""
    with open(b_path, "rb") as g:
        b_size = Pieces(g.read()).size
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    made = align(rows, a_path, b_path, ["_row", "doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stash(made.select("_row", "doc_id", "n_a", "n_b", digest.alias("groups_sha256"), "links"), codec="zstd")
    sums = link_sums(rows, link_counts(rows, b_size), "_row")
    n = F.size("links").cast("long")
    out = rows.select("_row", "doc_id", "n_a", "n_b", n.alias("n_groups"), n.alias("n_links"), "groups_sha256").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
