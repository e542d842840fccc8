import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import near_duplicates as N
from vantage.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(n_shingles, component_id, kept) per doc_id by an exact prefix filter."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    often = Counter(s for x in sets.values() for s in x)
    index = defaultdict(list)
    for i, s in sets.items():
        seen = set()
        for t in sorted(s, key=lambda t: (often[t], t))[: len(s) - (75 * len(s) + 99) // 100 + 1]:
            seen.update(index[t])
            index[t].append(i)
        for j in seen:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus():
    """A hot family of edited copies, exact copies, chains, and texts that stand alone."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    base = list(rng.choice(words, 120))
    rows = []
    for k in range(160):
        w = list(base)
        for p in rng.choice(len(w), rng.integers(0, 9), replace=False):
            w[p] = f"edit{k}x{p}"
        rows.append((1000 + k, " ".join(w)))
    chain = list(rng.choice(words, 200))
    for k in range(8):
        rows.append((500 + k, " ".join([f"step{j}" for j in range(12 * k)] + chain[12 * k :])))
    rows += [(2000 + k, " ".join(base).upper()) for k in range(30)]
    rows += [(3000 + k, " ".join(rng.choice(words, 60))) for k in range(60)]
    rows += [(4000, "a b"), (4001, "A  B"), (4002, "a b c"), (4003, None), (4004, ""), (4005, " \n"), (4006, "big " * 40_000)]
    return rows


def test_matches_brute_force(spark, make_docs):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.classes(make_docs(rows, extra=True)).collect()}
    assert got == brute(rows)


def test_cross_pairs_are_whole(spark):
    """Blocks of buckets lose no pair and give each once."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(3)]
    nodes = []
    for k in range(700):
        s = sets[k % 3].copy()
        s[: 5 * (k % 4)] = rng.integers(0, 2**63, 5 * (k % 4)).astype(np.uint64)
        s = np.unique(s)
        nodes.append((k, k, len(s), [int(x) for x in N.signature(s)], bytearray(N.sketch(s).tobytes())))
    df = spark.createDataFrame(nodes, "node long, component long, n int, sig array<int>, sketch binary")
    keys = N.bucket_keys(df)
    size = keys.groupBy("key").count().withColumnRenamed("count", "size")
    pairs = [(r.u, r.v) for r in N.cross_pairs(keys.join(size, "key").join(df, "node")).collect()]
    assert len(pairs) == len(set(pairs))
    sig = np.array([x[3] for x in nodes])
    expect = set()
    for i in range(len(nodes)):
        same = (sig[i + 1 :] == sig[i]).reshape(-1, N.CHUNKS, N.WIDTH)
        shared = (same.sum(axis=2) >= N.WIDTH - 1).any(axis=1) & (same.sum(axis=(1, 2)) >= N.MIN_EQUAL)
        for j in np.flatnonzero(shared) + i + 1:
            fine = np.frombuffer(bytes(nodes[j][4]), np.uint8)[None]
            if N.sketches_agree(np.frombuffer(bytes(nodes[i][4]), np.uint8), fine, nodes[i][2], np.array([nodes[j][2]]))[0]:
                expect.add((i, int(j)))
    assert set(pairs) == expect and len(expect) > 70_000


@settings(max_examples=40, deadline=None)
@given(st.integers(20, 2000), st.floats(0.75, 0.99), st.integers(0, 10**6))
def test_sketch_keeps_similar_sets(n, share, seed):
    rng = np.random.default_rng(seed)
    both = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
    own = int(n * (1 - share) / share / 2)
    a = np.unique(np.r_[both, rng.integers(0, 2**63, own).astype(np.uint64)])
    b = np.unique(np.r_[both, rng.integers(0, 2**63, own).astype(np.uint64)])
    assert N.sketches_agree(N.sketch(a), N.sketch(b)[None], len(a), np.array([len(b)]))[0]


def test_repeated_rows_and_null_ids(spark, make_docs):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text), (5, text), (3, text + " eleven"), (None, text), (None, "unnamed words that nobody else has here"), (None, None), (8, "x y z")]
    docs = make_docs(rows, extra=True)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in N.classes(docs).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, 3, False), (None, None, True), (None, None, True), (8, 8, True)], key=str)
    kept = N.keep_one(docs.unionByName(make_docs([(8, "x y z")], extra=True)))
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "8", "None", "None"]


def test_empty(spark, make_docs):
    assert N.classes(make_docs([])).count() == 0 and N.keep_one(make_docs([])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)]
    edges += [(5000, k) for k in range(5001, 5200)] + [(7, 7), (9, 8), (8, 9)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
