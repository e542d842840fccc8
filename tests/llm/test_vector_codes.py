import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import queries as Q
from vantage.llm import vector_codes as V


def nearest(entries, queries):
    d2 = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return d2.argmin(axis=1), d2.min(axis=1)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(0, 4), st.sampled_from([1, 3, 50, 2**27]), st.integers(0, 10**6))
def test_tree_finds_the_nearest_entry(n, width, repeats, spread, seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (n, width))
    for _ in range(repeats):  # equal entries: the lower index wins
        entries[rng.integers(n)] = entries[rng.integers(n)]
    queries = np.concatenate([rng.integers(-spread, spread + 1, (200, width)), entries])
    got = V.Search(entries, V.build_tree(entries), queries)
    index, d2 = nearest(entries, queries)
    assert (got.index == index).all() and (got.best == d2).all()


def test_tree_leaves_entries_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (8, 4))
    entries = np.concatenate([c + rng.integers(-20, 20, (8, 4)) for c in centres])
    queries = np.concatenate([c + rng.integers(-20, 20, (500, 4)) for c in centres])
    got = V.Search(entries, V.build_tree(entries), queries)
    assert (got.index == nearest(entries, queries)[0]).all()
    assert got.compared < 0.4 * len(entries) * len(queries)


def test_rounding_of_roots():
    d2 = np.array([0, 1, 2, 3, 4, 15, 16, 17, 2**56 - 1, 2**56, 2**56 + 1])
    for x, down, up in zip(d2.tolist(), V.root_down(d2).tolist(), V.root_up(d2).tolist(), strict=True):
        exact = math.isqrt(x * V.GRID**2)
        assert down == exact and up == exact + (exact**2 != x * V.GRID**2)


def brute(rows):
    """(vec_id, label, code, error, label_error) and the digest, in plain Python."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, [math.floor(256 * np.float32(c).item()) for c in v], x) for i, v, x in kept]
    top = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    w = len(top[0][1]) // 16
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(r[1], p) for r in top] for p in range(16)]

    def best(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        new = [[list(e) for e in b] for b in books]
        for p in range(16):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(best(p, cut(v, p))[1], []).append(cut(v, p))
            for k, parts in mine.items():
                new[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
        books = new
    out = []
    for i, v, x in kept:
        found = [best(p, cut(v, p)) for p in range(16)]
        out.append((i, x, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    by_label = {}
    for r in out:
        by_label[r[1]] = by_label.get(r[1], 0) + r[3]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[x], digest) for i, x, c, e in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, _v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, x, "mine", "mine", 1) for i, v, x in rows], SCHEMA)


def run(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q.op13_gnat_codes(spark, str(tmp_path)).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=str)


@pytest.mark.parametrize("n", [1, 40, 300])
def test_matches_brute_force(spark, tmp_path, n):
    rng = np.random.default_rng(n)
    base = rng.normal(0, 0.1, (5, 32))
    rows = [(int(k * 7 % 1009), [float(np.float32(c)) for c in base[k % 5] + rng.normal(0, 0.02, 32)], [None, 1, 2][k % 3]) for k in range(n)]
    rows += rows[:3] + [(None, rows[0][1], 1)]  # repeated rows and a null id
    bad = [(5000, None, 1), (5001, [None, *rows[0][1][1:]], 1), (5002, [float("nan"), *rows[0][1][1:]], 2), (-9, [float("inf"), *rows[0][1][1:]], 2)]
    assert run(spark, tmp_path, rows + bad) == brute(rows)


def test_freak_vectors(spark, tmp_path):
    """Vectors of an unusual length go, huge components are held at the bound, widths are filled up."""
    rows = [(1, [0.5] * 20, 1), (2, [-0.25] * 20, 1), (3, [1e30] * 20, None), (4, [0.5] * 7, 2), (5, [], 2)]
    got = run(spark, tmp_path, rows)
    assert [r[0] for r in got] == [1, 2, 3] and all(r[2] == 0 and r[3] == 0 for r in got)


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    assert V.compress(table(spark, [(1, None, 1)]))[0].count() == 0
