import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, bench, width=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = WORD.findall(lower(text))
    hit, items = set(), set()
    for item, t in bench:
        w = WORD.findall(lower(t))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    items.add("" if item is None else str(item))
    return len(words), len(hit), sorted(items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_suffix_array(xs):
    seq = [*xs, -1]
    order = D.suffix_array(np.array(seq))
    assert order.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=25), min_size=1, max_size=5), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_index_counts_and_locates(runs, window):
    runs = [r for r in runs if r] or [[1]]
    symbols = np.array([x for r in runs for x in (*r, 0)])
    which, at = D.FMIndex(symbols, 3).search(np.array([window], np.int32))
    n = len(window)
    expect = [i for i in range(len(symbols) - n + 1) if symbols[i : i + n].tolist() == window]
    assert sorted(at.tolist()) == expect and set(which.tolist()) <= {0}


@pytest.mark.parametrize("block_words,shard_words", [(4_000_000, 1_000_000), (1, 3)])
def test_matches_brute_force(spark, make_docs, block_words, shard_words):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = [(1, item), (2, "short one"), (3, None), (None, "x y"), (1, item), (4, "élan vital élan vital")]
    texts = [
        item,
        "pre " + item.upper() + ", post; short-one",
        "alpha beta gamma delta epsilon zeta eta theta iota",
        None,
        "",
        "short one short one x y",
        "élan vital élan vital élan vital",
        "w " * 5000 + "short one",
        "w " * 5000 + "short one",
    ]
    docs = make_docs([(i if i < 7 else 7, t) for i, t in enumerate(texts)], extra=True)
    found = D.decontaminate(
        docs, spark.createDataFrame(bench, "item_id long, text string"), block_words=block_words, shard_words=shard_words
    )
    rows = found.collect()
    assert len(rows) == len(texts) and rows[0]["score"] == "mine"
    for r in rows:
        assert (r.n_words, r.n_hit, sorted(r["items"])) == brute(r.text, bench)
        assert r.contaminated == (r.n_hit > 0)


def test_empty_tables_and_cut(spark, make_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.decontaminate(make_docs([(1, "a b")]), bench).collect()] == [False]
    assert D.decontaminate(make_docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    bench = spark.createDataFrame([(1, "leaked secret text")], "item_id long, text string")
    out = D.cut_spans(D.decontaminate(make_docs([(1, "Keep  this. Leaked secret, TEXT and this"), (2, "All  clean.")]), bench))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "Keep  this. and this", 2: "All  clean."}
