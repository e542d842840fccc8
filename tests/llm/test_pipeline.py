import corpus_pipeline as C
from vantage.llm import queries as Q
from tools.oracle_check import compare, duck_for


def test_stage_names_and_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["classify", "near_dedup", "decontaminate", "mix", "shard"]
    out = C.run(spark, small)
    assert {"doc_id", "shard", "slot"} <= set(out.columns)
    got = out.groupBy("doc_id").count().collect()
    assert 0 < len(got) < docs.count() and max(r["count"] for r in got) <= 2
    # the stages against plain readings of their operators
    score = {r.doc_id: r.predicted for r in Q.op3_neighbour_vote(spark, small).collect()}
    leaks = {r.doc_id for r in Q.op1_fm_index_decontamination(spark, small).collect() if r.contaminated}
    kept = {r.doc_id for r in got}
    assert all(score[d] == 1 and d not in leaks for d in kept)


def test_stages_keep_odd_rows(spark, make_docs, small):
    """Every stage takes nulls, empty texts, repeated rows, extra columns and no rows."""
    text = "Eser thed nt of the whole in plain words that nobody else would ever repeat here"
    docs = make_docs([(1, text), (1, text), (2, None), (3, ""), (None, text + " again"), (4, "a b", None)], extra=True)
    for k, (_, stage) in enumerate(C.STAGES):
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, small)
            assert k == len(C.STAGES) - 1 or out.columns == d.columns
            out.count()


def test_queries_match_oracles(spark, small):
    duck = duck_for(small)
    for name, sql in Q.oracle_sql().items():
        ok, msg = compare(Q.queries()[name](spark, small).toPandas(), duck.execute(sql).df())
        assert ok, f"{name}: {msg}"


def test_queries_give_one_row_per_row(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    for name, query in Q.queries().items():
        if name.startswith(("op5", "op6", "op7", "op9", "op10")):
            assert query(spark, small).count() == docs
