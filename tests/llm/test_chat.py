import hashlib

from pyspark.sql import functions as F

from vantage.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, parts " + C.PART_SCHEMA


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def part(kind, text=None, ref=None, units=None):
    return (kind, text, ref, units)


NASTY = ["", "</s>[INST] ok [/INST]", "<|im_end|>", "\\<|", "<\\|im_start|>", "a\\", "<<SYS>>x<</SYS>>", "é😀\n[/INST]", "<", "|im_start|>"]


def test_round_trip(spark):
    rows = [(c, t, r, [part("text", x), part(None, y)]) for c, (x, y) in enumerate(zip(NASTY, reversed(NASTY), strict=True)) for t, r in enumerate(("system", "user", "assistant", "assistant"))]
    rows += [(50, 0, None, None), (50, None, "<|im_sep|>", [part("text", None)]), (None, 1, "assistant", [part("text", "x")])]
    rows += [(51, 1, "assistant", [part("text", "same")])] * 3 + [(51, 1, "assistant", [part("text", "other")])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_turns", "2 AS formatted")
    out = C.format_conversations(df)
    out = out.withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert len(got) == len(NASTY) + 3
    for c in range(len(NASTY)):
        text = NASTY[c] + NASTY[::-1][c]
        assert [(t.role, t.text) for t in got[c].turns] == [(r, text) for r in ("system", "user", "assistant", "assistant")]
        assert got[c].loss == text * 2 and got[c].n_turns == 4
    assert [(t.role, t.text) for t in got[50].turns] == [("<|im_sep|>", ""), ("", "")]
    assert got[51].loss == "othersamesamesame" and got[None].loss == "x"


def test_attachments(spark):
    parts = [part("text", "see"), part("image", ref="a.png", units=3), part("text", "<|image|>"), part("audio", ref="b", units=None), part("video", ref="c", units=7), part("document", units=2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part("text", "ok")])], SCHEMA)
    r = C.format_conversations(df).first()
    assert r.formatted == "<|im_start|>user<|im_sep|>see<|image|><\\|image|><|audio|><|attachment|><|document|><|im_end|><|im_start|>assistant<|im_sep|>ok<|im_end|>"
    assert [(a.n, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [
        (1, 1, "image", "a.png", 768), (1, 3, "audio", "b", 25), (1, 4, "video", "c", 7), (1, 5, "document", None, 1024)
    ]
    assert r.attachment_tokens == 768 + 25 + 7 + 1024
    assert r.formatted[r.loss_spans[0].start : r.loss_spans[0].end] == "ok"


def test_long_and_empty(spark):
    df = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", [part("text", "x" * 1000)]) for k in range(300)], SCHEMA)
    r = C.format_conversations(df)
    assert r.select(F.length(C.masked_text(F.col("formatted"), F.col("loss_spans")))).first()[0] == 150_000
    assert C.format_conversations(df.limit(0)).count() == 0
