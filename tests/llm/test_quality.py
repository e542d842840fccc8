import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.llm import quality_classifier as C
from vantage.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------- classifier
def test_held_out_rows_and_accuracy(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    hidden = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda ls: {r.doc_id: r.score for r in C.score_documents(docs, C.fit(docs, ls), ["doc_id"]).collect()}
    got = score(labels)
    assert got == pytest.approx(score(hidden), abs=1e-6)  # labels of held-out rows do not count
    own = [(r.quality, got[r.doc_id] >= 0.5) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(q == p for q, p in own) >= 0.9 * len(own)


def test_votes_are_exact(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = C.fit(docs, labels)
    terms = C.Terms()
    rows = [terms.counts(r.text) for r in docs.limit(40).collect()]
    latent = model.project(rows)
    got = model.vote(latent)
    for q, vote in zip(latent, got, strict=True):
        close = model.vectors @ q
        near = sorted(range(len(close)), key=lambda k: -close[k])[: C.NEIGHBOURS]
        w = np.array([max(close[k], 1e-6) ** C.SHARPNESS * model.weights[k] for k in near])
        edge = sorted(close)[-C.NEIGHBOURS - 1]
        if close[near[-1]] - edge > 1e-6:  # no tie at the last neighbour
            assert vote == pytest.approx(float((w * model.labels[near]).sum() / w.sum()), abs=1e-4)


def test_classifier_edges(spark, make_docs):
    docs = make_docs([(1, "Good plain words."), (2, "###%%% &&&"), (3, None), (4, ""), (None, "more words"), (2, "###%%% &&&")], extra=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, 0), (4, None)], "doc_id long, quality int")
    rows = C.score_documents(docs, C.fit(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and rows[0]["size"] == "mine"
    assert {r.score for r in rows if not r.text} == {0.0}
    none = labels.limit(0)
    assert {r.score for r in C.score_documents(docs, C.fit(docs, none)).collect() if r.text} == {1.0}
    assert C.score_documents(docs.limit(0), C.fit(docs.limit(0), labels)).count() == 0


# ------------------------------------------------------------- rules
def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_counts(spark, make_docs, small):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x x x x x x x", "l\nl\n\nl \n", "#é|<> 😀 ok", "w " * 30_000, "one two three four five"]
    docs = make_docs(list(enumerate(texts)), extra=True).unionByName(
        spark.read.parquet(f"{small}/documents.parquet").limit(60), allowMissingColumns=True
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in R.counts(docs).collect():
        assert tuple(r[n] for n in names) == brute_counts(r.text)


def test_distances_and_verdicts(spark):
    """The estimate against numpy, and planted outliers against clean rows."""
    rng = np.random.default_rng(3)
    base = rng.normal([1.7, 0.05, 0.1, 0.1, 0.2], [0.05, 0.01, 0.05, 0.05, 0.04], (400, 5))
    bad = base[:40] + [0, 0.6, 0, 0, 0.7]
    rows = [("en", "s", *map(float, x)) for x in (*base, *bad)] + [(None, None, *map(float, x)) for x in base[:100]]
    schema = "lang string, source string, " + ", ".join(f"{f} double" for f in R.FEATURES)
    df = spark.createDataFrame(rows, schema)
    groups = R.estimates(df)
    assert groups.count() == 2
    got = [r.d2 for r in R.distances(df, groups).where("lang = 'en'").collect()]
    assert sorted(got)[399] < R.CUTOFF < sorted(got)[400]
    g = groups.where("lang = 'en'").first()
    factor = np.array([[g[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    mean = np.array([g[f"m_{i}"] for i in range(5)])
    expect = [float((x - mean) @ np.linalg.inv(factor @ factor.T) @ (x - mean)) for x in (*base, *bad)]
    assert sorted(got) == pytest.approx(sorted(expect), rel=1e-6)
    clean = np.cov(base.T, bias=True) + np.diag([s * s for s in R.FEATURES.values()])
    assert np.linalg.slogdet(factor @ factor.T)[1] == pytest.approx(np.linalg.slogdet(clean)[1], abs=1.5)


def robust(x):
    """Half-sample minimum covariance determinant from the same two starts, to the end."""
    floors = np.array(list(R.FEATURES.values()))
    h = (len(x) + 6) // 2
    fit = lambda c, k: (c.mean(0), k * np.cov(c.T, bias=True) + np.diag(floors**2))
    far = lambda g: np.einsum("ij,ij->i", x - g[0], np.linalg.solve(g[1], (x - g[0]).T).T)
    mid = np.median(x, 0)
    unit = np.maximum(1.4826 * np.median(abs(x - mid), 0), floors)
    found = []
    for d in ((((x - mid) / unit) ** 2).sum(1), far(fit(x, 1.0))):
        for _ in range(60):
            g = fit(x[d <= np.sort(d)[h - 1]], R.consistency(h / len(x)))
            d = far(g)
            found.append((np.linalg.slogdet(g[1])[1], d))
    return min(found, key=lambda f: f[0])


def test_a_third_of_a_group_may_be_copies(spark):
    """One group of junk copies holds a third of its group: all are rejected, no clean row is."""
    rng = np.random.default_rng(5)
    clean = rng.normal([1.7, 0.05, 0.1, 0.1, 0.2], [0.05, 0.01, 0.05, 0.05, 0.04], (400, 5))
    junk = np.repeat([[1.7, 0.55, 0.1, 0.1, 0.2]], 200, 0)
    near = junk + rng.normal(0, 0.01, junk.shape)
    groups = {"copies": np.vstack([clean, junk]), "near": np.vstack([clean, near]), "clean": clean}
    schema = "lang string, source string, row int, " + ", ".join(f"{f} double" for f in R.FEATURES)
    df = spark.createDataFrame([("en", s, k, *map(float, v)) for s, x in groups.items() for k, v in enumerate(x)], schema)
    est = R.estimates(df)
    out = R.distances(df, est).collect()
    for s, x in groups.items():
        d2 = [r.d2 for r in sorted(out, key=lambda r: r.row) if r.source == s]
        assert max(d2[:400]) < R.CUTOFF and min(d2[400:], default=R.CUTOFF + 1) > R.CUTOFF
        logdet, expect = robust(x)
        assert est.where(F.col("source") == s).first().logdet == pytest.approx(logdet, abs=0.1)
        assert np.median(d2[:400]) == pytest.approx(np.median(expect[:400]), rel=0.1)


def test_small_groups_have_a_wider_estimate(spark):
    """Groups under MIN_ROWS are measured by their language, small languages by all rows."""
    rng = np.random.default_rng(6)
    clean = rng.normal([1.7, 0.05, 0.1, 0.1, 0.2], [0.05, 0.01, 0.05, 0.05, 0.04], (240, 5))
    junk = [1.7, 0.55, 0.1, 0.1, 0.2]
    names = [("en", f"s{k % 20}") for k in range(200)] + [(None, "s1")] * 20 + [("fr", None)] * 20
    rows = [(*n, 0, *map(float, x)) for n, x in zip(names, clean, strict=True)]
    rows += [(*n, 1, *junk) for n in (("en", "s3"), ("en", "rare"), (None, "s1"), ("de", "s3"), ("fr", None))]
    schema = "lang string, source string, bad int, " + ", ".join(f"{f} double" for f in R.FEATURES)
    df = spark.createDataFrame(rows, schema)
    est = R.estimates(df)
    assert est.count() == df.select("lang", "source").distinct().count()
    out = R.distances(df, est).collect()
    assert len(out) == len(rows) and all((r.d2 > R.CUTOFF) == bool(r.bad) for r in out)
    assert est.where("lang = 'en'").select("logdet").distinct().count() == 1
    assert est.select("logdet").distinct().count() == 2


def test_core_factors():
    assert R.consistency(0.5) == pytest.approx(1.912, abs=1e-3) and R.consistency(0.75) == pytest.approx(1.412, abs=1e-3)
    assert R.consistency(1.0) == 1.0 and R.FACTORS == sorted(R.FACTORS, reverse=True)


def test_rules_edges(spark, make_docs):
    rows = [(k, f"plain words number {k} in a text of more than ten words here", None if k % 2 else "s") for k in range(120)]
    rows += [(500, None, "s"), (501, "", None), (None, "a b c", "s"), (0, rows[0][1], "s")]
    out = R.screen_documents(make_docs(rows, extra=True)).collect()
    assert len(out) == len(rows)
    for r in out:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and (not r.kept or not failed)
    assert R.screen_documents(make_docs([])).count() == 0
