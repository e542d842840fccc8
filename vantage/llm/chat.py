"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is an array of typed parts.  A visitor expression flattens the parts in
order: text is escaped, and image, audio and document parts become placeholders.
Each attachment is recorded with its reference and the number of tokens that its
placeholder expands to.  Turns are marked by control strings; the escape puts a
backslash behind the first character of any control string in a text (and doubles
backslashes), so texts can be read back unchanged.

Defined results: null text is empty; null role is empty; a null turn sorts first;
rows of one turn sort by role and text, and equal rows are all kept; a null conv_id
is a conversation of its own; an empty table gives no rows; other input columns are
ignored.  The rows of one conversation meet in one task since its output is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_SCHEMA = "array<struct<type:string,text:string,ref:string,units:long>>"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Placeholder and tokens per unit (image tiles, audio seconds, document pages).
PLACEHOLDERS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 512)}
OTHER_PLACEHOLDER = "<|attachment|>"
# The first character and the rest of every control string, own and
# of other common templates.
CONTROL = r"(<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            null.cast("string").alias("ref"),
            null.cast("long").alias("units"),
        )
    )


def visit(part: Column) -> Column:
    """Flattened form of one part; a null type is text."""
    out = F.when(F.coalesce(part["type"], F.lit("text")) == "text", escape(part["text"]))
    for kind, (mark, _) in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(OTHER_PLACEHOLDER))


def part_tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part expands to (unknown kinds: its units)."""
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    out = F.when(F.coalesce(part["type"], F.lit("text")) == "text", F.lit(0).cast("long"))
    for kind, (_, per_unit) in PLACEHOLDERS.items():
        out = out.when(part["type"] == kind, units * per_unit)
    return out.otherwise(units)


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts): formatted,
    n_turns, loss_spans (code-point ranges of assistant texts in formatted, end
    exclusive), attachments (turn number, part number, type, ref, tokens; in order)
    and attachment_tokens."""
    m = messages.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("parts", F.array().cast(PART_SCHEMA)).alias("parts"),
    )
    body = F.array_join(F.transform("parts", visit), "")
    m = m.withColumn("body", body)
    m = m.withColumn("_head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    m = m.withColumn("_turn", F.concat("_head", "body", F.lit(END)))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")]
    w = Window.partitionBy("conv_id").orderBy(*order, "_key")
    before = F.coalesce(F.sum(F.length("_turn")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = (
        m.withColumn("_key", F.to_json("parts"))
        .withColumn("_n", F.row_number().over(w))
        .withColumn("_start", (before + F.length("_head")).cast("long"))
        .withColumn("_end", F.col("_start") + F.length("body"))
    )
    files = F.filter(
        F.transform(
            "parts",
            lambda p, i: F.struct(
                F.col("_n").alias("n"),
                i.alias("part"),
                p["type"].alias("type"),
                p["ref"].alias("ref"),
                part_tokens(p).alias("tokens"),
            ),
        ),
        lambda x: F.coalesce(x["type"], F.lit("text")) != "text",
    )
    turn = F.struct("_n", "_turn", (F.col("role") == "assistant").alias("loss"), "_start", "_end", files.alias("files"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    g = g.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["_turn"]), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        F.transform(
            F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["_start"].alias("start"), x["_end"].alias("end"))
        ).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return g.withColumn("attachment_tokens", tokens)


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def one(piece):
        cut = F.split(piece, r"<\|im_sep\|>|<\|im_end\|>")
        return F.struct(unescape(cut[0]).alias("role"), unescape(cut[1]).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(spans, lambda s: unescape(cut(s))), "")
