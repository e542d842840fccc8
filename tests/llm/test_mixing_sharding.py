import zlib

import pytest
from pyspark.sql import functions as F

from vantage.llm import mixing as M
from vantage.llm import sharding as S


# ------------------------------------------------------------- mixing
def brute_targets(sizes):
    """Caps and shares by repeated resharing in plain Python."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, left, todo = {}, 1.5 * sum(sizes.values()), set(order)
    while todo:
        total = sum(weight[s] for s in todo)
        over = {s for s in todo if left * weight[s] / total > 2 * sizes[s]}
        for s in over or todo:
            out[s] = 2.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        left -= sum(out[s] for s in over)
        todo -= over
    return out


def test_mix_meets_targets(spark, make_docs):
    rows = [(k, "w " * (1 + k % 40), ["a", "b", "c", "d", None, "é", "z"][min(k % 9, 6)]) for k in range(3000)]
    rows += [(9000, None, "a"), (9001, "", "b"), (None, "x y", "c"), (5, rows[5][1], rows[5][2]), (9002, "", "only empty")]
    docs = make_docs(rows, extra=True)
    slim, per_source = M.plan(docs)
    got = [r.asDict() for r in M.copies(slim, per_source).collect()]
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    expect = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(expect[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - expect[s]) <= 40
    again = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in got}
    once_more = M.copies(*M.plan(docs.repartition(7))).collect()
    assert {(r.doc_id, r.source, r["size"]): r.copies for r in once_more} == again
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)


def test_mix_edges(spark, make_docs):
    assert M.mix_documents(make_docs([])).count() == 0
    assert M.copies(*M.plan(make_docs([(1, None), (2, "")]))).agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == 0
    one = M.copies(*M.plan(make_docs([(1, "a " * 100_000)]))).first()
    assert (one["size"], one.target) == (100_000, 150_000.0)


def test_measure_counts_words(spark, make_docs, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(make_docs([(1, " a b c \x0bd\x1ce ")]))
    for r in M.measure(docs).select("text", "size").collect():
        assert r["size"] == len(r.text.encode().split())


# ------------------------------------------------------------- sharding
def check_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_shards_are_even_and_gapless(spark, make_docs):
    docs = make_docs([(k, "é" * (k % 50)) for k in range(4000)] + [(None, "n"), (None, "n"), (7, None), (3, "ééé")], extra=True)
    rows = S.shard_documents(docs, 8).collect()
    assert len(rows) == 4004 and rows[0]["score"] == "mine"
    check_gapless(rows)
    load = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert max(load) - min(load) <= 101
    for r in rows:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None


def test_map_versions(spark, make_docs, tmp_path):
    path = str(tmp_path / "map")
    docs = make_docs([(k, "x" * (k % 30)) for k in range(3000)])
    first = {r.doc_id: r.shard for r in S.shard_documents(docs, 8, map_path=path).collect()}
    again = S.shard_documents(docs, 8, map_path=path).collect()
    assert {r.doc_id: r.shard for r in again} == first and {r.map_version for r in again} == {2}
    grown = S.shard_documents(docs, 9, map_path=path).collect()
    check_gapless(grown)
    moved = [r for r in grown if r.shard != first[r.doc_id]]
    assert 0.08 * len(grown) < len(moved) < 0.15 * len(grown)
    assert sum(r.shard != 8 for r in moved) < 0.01 * len(grown)  # evening out the last bytes
    less = S.shard_documents(docs, 7, map_path=path).collect()
    assert {r.shard for r in less} == set(range(7))
    assert [r[0] for r in S.load_map(spark, path, 1)] == [1] * S.N_SLOTS
    load = [sum(r["size"] for r in less if r.shard == k) for k in range(7)]
    assert max(load) - min(load) <= 0.02 * sum(load) / 7


def test_shard_empty(spark, make_docs):
    assert S.shard_documents(make_docs([]), 8).count() == 0
