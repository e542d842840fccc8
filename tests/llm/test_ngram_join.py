import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(n_shingles, component_id) per doc_id from all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[k : k + 3]) for k in range(len(w) - 2)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for x in s for j in index[x])
        for j, both in common.items():
            if 100 * both >= 90 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s:
            index[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    """Small and large families of edited copies, chains, a passage that many share."""
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(2000)]
    rows, i = [], 0
    for length, copies in ((11, 40), (14, 30), (22, 40), (31, 20), (60, 60), (150, 90)):
        base = list(rng.choice(words, length))
        for k in range(copies):
            w = list(base)
            for p in rng.choice(len(w), rng.integers(0, 1 + max(1, length // 40)), replace=False):
                w[p] = f"edit{i}x{p}"
            rows.append((100 + i, " ".join(w if k % 3 else w[: len(w) - k % 2] + ["end"] * (k % 2))))
            i += 1
    chain = list(rng.choice(words, 200))
    rows += [(5000 + k, " ".join([f"step{j}" for j in range(7 * k)] + chain[7 * k :])) for k in range(10)]
    passage = " ".join(rng.choice(words, 30))
    rows += [(6000 + k, " ".join(rng.choice(words, 20)) + " " + passage) for k in range(80)]
    rows += [(7000 + k, passage + (f" tail{k % 5}" if k % 2 else "")) for k in range(30)]
    rows += [(8000, "a b"), (8001, "A  B"), (8002, "a b c"), (8003, None), (8004, ""), (8005, " \n"), (8006, "big " * 40_000)]
    rows += [(8007, " ".join(f"v{k}" for k in range(9000))), (8008, " ".join(f"v{k}" for k in range(150, 9000)))]
    return rows


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("boundary", [None, 0, 12, 30])
def test_matches_brute_force(spark, make_docs, monkeypatch, boundary):
    """The result does not depend on where the boundary lies."""
    chosen = []
    choose = J.choose_boundary
    monkeypatch.setattr(J, "choose_boundary", lambda *x: chosen.append(choose(*x)) or (chosen[0] if boundary is None else boundary))
    monkeypatch.setattr(J, "BLOCK", 16)
    if boundary:
        monkeypatch.setattr(J, "SHORT", boundary)  # long lists too
    rows = corpus()
    assert result(J.join_documents(make_docs(rows, extra=True))) == brute(rows)
    assert 8 <= chosen[0] < J.SMALL_MAX


def test_boundary_is_the_cheapest(spark):
    sizes = [(k, s) for s, m in ((9, 50), (20, 10), (30, 4)) for k in range(m)]
    nodes = spark.createDataFrame(sizes, "node long, n long")
    entries = lambda n: spark.createDataFrame([(s, n) for _, s in sizes], "n long, size long")
    # 50 keys of size 9, 10 x 211 of size 20, 4 x 4,496 of size 30, against lists of one length
    assert [J.subset_count(s) for s in (8, 9, 10, 20, 30)] == [0, 1, 11, 211, 4526]
    assert J.choose_boundary(nodes, entries(1)) == 8
    assert J.choose_boundary(nodes, entries(100)) == 9
    assert J.choose_boundary(nodes, entries(1000)) == 20
    assert J.choose_boundary(nodes, entries(10_000)) == 30


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 45), st.integers(0, 5), st.integers(0, 5), st.integers(0, 10**6))
def test_linked_small_sets_share_a_subset(common, left, right, seed):
    rng = np.random.default_rng(seed)
    m = np.unique(rng.integers(0, 2**63, common + left + right).astype(np.uint64))
    a, b = np.sort(m[: common + left]), np.sort(np.r_[m[:common], m[common + left :]])
    if len(a) > 29 or len(b) > 29 or not (left or right):
        return
    linked = 100 * common >= 90 * (common + left + right)
    assert linked <= bool(np.intersect1d(J.subset_keys(a), J.subset_keys(b)).size)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 700), st.integers(0, 80), st.integers(0, 80), st.integers(0, 10**6))
def test_linked_sets_share_a_list_and_pass_the_sketch(common, left, right, seed):
    rng = np.random.default_rng(seed)
    m = np.unique(rng.integers(0, 2**64, common + left + right, dtype=np.uint64))
    rng.shuffle(m)
    a, b = np.sort(m[: common + left]), np.sort(np.r_[m[:common], m[common + left :]])
    frequent = np.sort(rng.choice(m, len(m) // 3, replace=False))
    places = rng.permutation(len(frequent)) + 1
    if 100 * common >= 90 * len(m):
        first = lambda x: J.in_order(x, frequent, places)[: J.first_members(len(x))]
        assert np.intersect1d(first(a), first(b)).size
        sa, sb = J.sketch(a), J.sketch(b)
        width = min(len(sa), len(sb))
        assert J.may_link(len(a), len(b), J.apart(J.fold(sa, width), J.fold(sb, width)))


@pytest.mark.parametrize("one", [True, False])
def test_cells_name_every_pair_in_rounds(one):
    """Asked again without what was refuted, a cell names every pair that links, and each
    time no more than so many for a member."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for k in range(120):
        s = base.copy()
        s[: rng.integers(0, 40)] = rng.integers(0, 2**63)
        sets.append(np.unique(s[: 300 - k % 3]))
    label, block = rng.choice([1, 1, 1, 2, 3], 120), rng.integers(0, 2, 120)
    size, sketches = np.array([len(s) for s in sets]), [J.sketch(s).tobytes() for s in sets]
    seen, refuted, closest = set(), [None] * 120, 3
    while True:
        u, v, more = J.Cell(np.arange(120), block, label, size, sketches, refuted, closest).pairs(one)
        got = {tuple(sorted(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}
        assert not got & seen and len(got) <= closest * 120
        seen |= got
        if not more.any():
            break
        closest *= 2
        refuted = [np.array([sum(p) - k for p in seen if k in p]) for k in range(120)]
    for i, j in itertools.combinations(range(120), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        asked = label[i] != label[j] and (one or block[i] != block[j])
        if asked and 100 * both >= 90 * (size[i] + size[j] - both):
            assert (i, j) in seen
        assert asked or (i, j) not in seen


def test_repeated_rows_and_null_ids(spark, make_docs):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(5, text), (5, text), (3, text + " fourteen"), (None, text), (None, "unnamed words that nobody else has here"), (None, None), (8, "x y z")]
    rows += [(9, "one id"), (9, "two texts")]
    got = sorted(((r.doc_id, r.component_id) for r in J.join_documents(make_docs(rows, extra=True)).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None), (None, None), (8, 8), (9, 9), (9, 9)], key=str)


def test_empty(spark, make_docs):
    assert J.join_documents(make_docs([])).count() == 0
    assert result(J.join_documents(make_docs([(1, None), (2, "")]))) == {1: (0, 1), 2: (0, 2)}
