import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vantage.llm import license_scan as L
from vantage.llm import personal_data as P

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ------------------------------------------------------------- licenses
def brute_base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "MIT License, mit-license; the mit licenses",
    "Apache License. GNU General Public License cc by cc by",
    "Licensed under CC BY-NC 4.0.",
    "x" * 300_000 + " mit license",
    "émit license",
]


def test_scan_matches_brute_force(spark, make_docs, small):
    docs = make_docs([(min(k, 5), t) for k, t in enumerate(TEXTS)], extra=True)
    docs = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet"), allowMissingColumns=True)
    out = L.scan_licenses(docs, ["doc_id", "text", "size", "n_words"]).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(r.text)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert L.scan_licenses(docs.limit(0), ["doc_id"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(L.NOTICES) - 1), st.integers(0, 10**6))
def test_edited_notices_are_found(k, seed):
    """Every notice with up to its allowed number of edits is found with its label."""
    notice, label, errors = L.NOTICES[k]
    rng = np.random.default_rng(seed)
    text = list(notice)
    for _ in range(rng.integers(0, errors + 1)):
        p = int(rng.integers(1, len(text) - 1))
        kind = rng.integers(3)
        if kind == 0:
            text[p] = "q"
        elif kind == 1:
            del text[p]
        else:
            text.insert(p, "q")
    r = L.Scanner().scan("Some words before. " + "".join(text) + " and some behind")
    assert label in r["labels"].split(",") and r["score"] > 0.5
    own = [x for x in r["notices"] if x["label"] == label]
    assert any(x["start"] <= 4 and x["end"] >= 3 + len("".join(text).split()) - 1 and x["edits"] <= errors for x in own)


def test_edited_notices_side_by_side():
    """Each of several notices in a row has its span, however good its neighbours are."""
    scan = L.Scanner().scan
    own = lambda r: [(x["start"], x["end"], x["edits"]) for x in r["notices"] if x["label"] == "mit"]
    r = scan("released under the mit licence released under the mit license released under th mit licenze")
    assert [x[:2] for x in own(r)] == [(0, 5), (5, 10), (10, 15)] and [x[2] > 0 for x in own(r)] == [True, False, True]
    copies = ["released under the mit license", "released under the mit licenqe", "releqsed under the mit licqnse"]
    order = [k * 7 % 3 if k % 2 else k * 5 % 3 for k in range(300)]
    got = own(scan(" ".join(copies[k] for k in order)))
    assert [x[:2] for x in got] == [(5 * k, 5 * k + 5) for k in range(300)]
    assert [x[2] for x in got] == order


def test_pieces_cover_the_notice():
    for notice, _, errors in L.NOTICES:
        cut = L.pieces(notice, errors)
        assert len(cut) == errors + 1 and "".join(p for _, p in cut) == notice
        assert all(notice[o : o + len(p)] == p and len(p) >= 5 for o, p in cut)


# ------------------------------------------------------------- personal data
SPEC = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in twice)) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in SPEC.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="019.@+-() _ab%é\n", max_size=40))
def test_base_spans_on_odd_texts(text):
    assert P.base_spans(text) == plain_base(text)


def test_base_spans_on_driver_texts(spark, small):
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        assert P.base_spans(r.text) == plain_base(r.text)


def test_field_learns_held_out_rows():
    tagger = P.Tagger(P.default_field())
    table = P.labelled_table(200, seed=123)
    found = tagger.labels([[w.encode() for w in words] for words, _ in table])
    right = total = 0
    for k, (_, labels) in enumerate(table):
        got = ["O"] * len(labels)
        for place, label in found.get(k, []):
            got[place] = P.LABELS[label]
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right > 0.97 * total


def test_gradient():
    """Two rounds on a small table raise its likelihood, found by summing over all paths."""
    table = P.labelled_table(6, seed=4)
    table = [(w[:4], t[:4]) for w, t in table]

    def likelihood(f):
        total = 0.0
        for words, labels in table:
            s = [P.shape(w) for w in words]
            row = lambda k: f.own[list(s[k])].sum(0) + (f.before[list(s[k - 1])].sum(0) if k else 0) + (f.after[list(s[k + 1])].sum(0) if k + 1 < len(s) else 0)  # noqa: B023, E731
            emit = [row(k) for k in range(len(s))]
            n = len(P.LABELS)
            score = lambda y: sum(emit[k][y[k]] for k in range(len(y))) + sum(f.step[a, b] for a, b in zip((0, *y), (*y, 0), strict=True))  # noqa: B023, E731
            y = tuple(P.LABELS.index(t) for t in labels)
            alpha = emit[0] + f.step[0]
            for k in range(1, len(s)):
                alpha = np.logaddexp.reduce(alpha[:, None] + f.step, axis=0) + emit[k]
            total += score(y) - np.logaddexp.reduce(alpha + f.step[:, 0])
            assert n == len(alpha)
        return total

    assert likelihood(P.train(table, rounds=30)) > likelihood(P.train(table, rounds=3)) > likelihood(P.train(table, rounds=1))


def test_decoding_is_exact():
    """Cutting texts at sure words gives the best path of the whole text."""
    field = P.default_field()
    tagger = P.Tagger(field)
    for words, _ in P.labelled_table(60, seed=31):
        got = [0] * len(words)
        for place, label in tagger.labels([[w.encode() for w in words]]).get(0, []):
            got[place] = label
        s = [list(P.shape(w)) for w in words]
        emit = np.array([field.own[x].sum(0) for x in s])
        emit[1:] += [field.before[x].sum(0) for x in s[:-1]]
        emit[:-1] += [field.after[x].sum(0) for x in s[1:]]
        assert P.viterbi(emit[None], field.step)[0].tolist() == got


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    emit, step = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3))
    for b, path in enumerate(P.viterbi(emit, step)):
        value = lambda y: sum(emit[b, k, y[k]] for k in range(4)) + sum(step[i, j] for i, j in zip((0, *y), (*y, 0), strict=True))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=4), key=value)
        assert value(tuple(path)) == pytest.approx(value(best))


def test_spans_of_documents(spark, make_docs):
    secret = "dfd1944d2e84f15e89902e34b677eb5a8a7d42ab"
    texts = [
        f'é mail a.b@x.org, token = "{secret}". Call +1 (168) 555-5254 now',
        None,
        "",
        "nothing here, 3.14 and 2024",
        "word " * 50_000 + "10.0.0.255 300.1.1.1",
        "nothing here, 3.14 and 2024",
    ]
    docs = make_docs([(min(k, 3), t) for k, t in enumerate(texts)], extra=True)
    out = {(r.doc_id, r.text): r for r in P.find_personal_data(docs, ["doc_id", "text", "size", "base"]).collect()}
    assert len(out) == 5
    first = out[0, texts[0]]
    assert [(s.kind, texts[0][s.start : s.end]) for s in first.spans] == [("email", "a.b@x.org"), ("phone", "+1 (168) 555-5254"), ("secret", secret)]
    assert [s.kind for s in first.base] == ["email", "phone"] and first["size"] == "mine"
    for r in out.values():
        assert [tuple(s) for s in r.base] == plain_base(r.text or "")
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    assert out[3, texts[3]].spans == [] and P.find_personal_data(docs.limit(0), ["doc_id"]).count() == 0
