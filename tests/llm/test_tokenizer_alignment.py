import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import queries as Q
from vantage.llm import tokenizer_alignment as T

A, B = f"{Q.TOKENIZERS}/byte_bpe_50k.json", f"{Q.TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(A), reason="no vocabularies")


def plain_overlaps(a, b):
    """Overlaps by a walk over both lists."""
    out, i, j = [], 0, 0
    while i < len(a):
        out.append((i, j, a[i] == b[j]))
        i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.floats(0.05, 1), st.floats(0.05, 1), st.integers(1, 30), st.integers(0, 10**6))
def test_overlaps_for_any_piece_size(n, share_a, share_b, work, seed):
    rng = np.random.default_rng(seed)
    a, b = (np.append(np.flatnonzero(rng.random(n) < s) + 1, n + 1) for s in (share_a, share_b))
    got = [(int(i), int(j), bool(c)) for i, j, c in zip(*T.overlaps(a, b, work), strict=True)]
    assert got == plain_overlaps(a.tolist(), b.tolist())


def test_pieces_do_equal_work():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.choice(10**6, 5000, replace=False)), np.sort(rng.choice(10**3, 900, replace=False))
    i, j = T.diagonal_splits(a, b, 64)
    assert set(np.diff(i + j)[:-1].tolist()) == {64} and (i[-1], j[-1]) == (5000, 900)
    assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()


def brute(rows):
    """The result by the vocabularies' own libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    alphabet = T._byte_alphabet()
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    texts = []
    for i, text in rows:
        a = tok.encode(" " + (text or ""), add_special_tokens=False)
        ab = [bytes(alphabet[c] for c in t) for t in a.tokens]
        bi = sp.encode(text or "")
        bb = [piece(k) for k in bi]
        whole = (" " + (text or "")).encode()
        ok = bool(text) and b"".join(ab) == whole and b"".join(bb) == whole
        texts.append((i, list(zip(a.ids, ab, strict=True)) if ok else [], list(zip(bi, bb, strict=True)) if ok else []))
    done, count = [], Counter()
    for i, a, b in texts:
        ends = lambda x: np.cumsum([len(t) for _, t in x]).tolist()
        ea, eb = ends(a), ends(b)
        cuts = sorted(set(ea) & set(eb))
        groups, links, last = [], [], 0
        for c in cuts:
            ga = [k for (k, _), e in zip(a, ea, strict=True) if last < e <= c]
            gb = [k for (k, _), e in zip(b, eb, strict=True) if last < e <= c]
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            links.append((ga[-1], gb[-1]))
            last = c
        count.update(links)
        done.append((i, len(a), len(b), len(cuts), ";".join(groups), links))
    top = {}
    for (_, k), n in count.items():
        top[k] = max(top.get(k, 0), n)
    return sorted(
        (
            (i, na, nb, n, n, sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if na else "")
            for i, na, nb, n, g, links in done
        ),
        key=str,
    )


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. The dog sleeps."),
    (2, "Zürich kostet 1.234,56 €; 東京 は 日本 の 首都 です 🙂🙂"),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "a▁b ▁"),  # B reads U+2581 as a space
    (7, "<|endoftext|> </s> <s> <unk> [INST]"),
    (8, "tab\tand\r\nline\x00null  two   three spaces   "),
    (8, "tab\tand\r\nline\x00null  two   three spaces   "),
    (None, "no id here"),
    (9, "word " * 3000 + "x" * 5000 + " " * 2000),
    (10, "ﬁne Ångstrom Å ​﻿"),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(docs):
    got = T.aligned_statistics(docs, A, B)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_matches_brute_force(spark, make_docs):
    docs = make_docs(ROWS, extra=True).selectExpr("*", "'mine' AS links", "'mine' AS groups", "'mine' AS n_a", "'mine' AS _row0")
    assert run(docs) == brute(ROWS)


def test_real_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_rare_pairs_are_joined(spark, make_docs):
    """The sums do not depend on how many pairs are broadcast."""
    docs = make_docs(ROWS).selectExpr("*", "monotonically_increasing_id() AS _row")
    rows = T.stash(T.align(docs, A, B, ["_row", "doc_id"]))
    counts = T.link_counts(rows, 32_000)
    sums = [sorted(map(tuple, T.link_sums(rows, counts, "_row", head).collect())) for head in (0, 3, 40, 10**6)]
    assert sums[0] == sums[1] == sums[2] == sums[3] and len(sums[0]) == 9


def test_blocks_of_long_texts(monkeypatch):
    """One block or many, and any piece size, give the same groups."""
    with open(A, "rb") as f, open(B, "rb") as g:
        aligner = T.vocabularies(f.read(), g.read())
    texts = [t for _, t in ROWS]
    whole = aligner.block(texts)
    for k, t in enumerate(texts):
        n_a, n_b, groups, links = aligner.block([t])
        assert (n_a[0], n_b[0], groups[0], links[0].tolist()) == (whole[0][k], whole[1][k], whole[2][k], whole[3][k].tolist())


def test_fast_merges_equal_the_file(small, spark):
    """Merging by rank gives what the vocabulary file's own library gives."""
    from tokenizers import Tokenizer

    with open(A, "rb") as f:
        fast = T.ByteLevel(f.read())
    assert "encode_ordinary" in repr(fast.encode)
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + [t for _, t in ROWS]
    for t in texts:
        assert fast.encode(" " + (t or "")) == tok.encode(" " + (t or ""), add_special_tokens=False).ids


def test_empty(spark, make_docs):
    assert run(make_docs([])) == []
    assert run(make_docs([(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
