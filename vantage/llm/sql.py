"""DuckDB SQL of the registered queries that SQL can express.

The other queries depend on a fitted model, a hash that DuckDB lacks or a parser; the
tests compare those with brute force, round trips or held-out labels."""

from __future__ import annotations

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACE = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER.format('text')}, {ALNUM}) AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i)
  WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER.format('text')}, {ALNUM}) AS w FROM documents
), sizes AS (SELECT DISTINCT len(win) AS n FROM win),
found AS (
  SELECT x.rid, x.i, x.n, win.item
  FROM (
    SELECT rid, i, n, list_slice(w, i, i + n - 1) AS win
    FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)
    WHERE len(w) >= n
  ) x JOIN win USING (win)
), words AS (
  SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) t(k) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for control in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP4 = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_sep|><|im_end|>') + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT)
    AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM m GROUP BY conv_id
"""

OP8 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, {SPACE}) AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i)
  WHERE len(w) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT u, v FROM (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
  ) p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * k >= 75 * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.v FROM r JOIN e ON r.b = e.u
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""



def _nearest(book: str) -> str:
    """(rid, part, k, d2): the nearest entry of a codebook, ties to the lower index."""
    d2 = " + ".join(f"(p.x{i} - b.x{i}) * (p.x{i} - b.x{i})" for i in range(4))
    return f"""
  SELECT rid, part, m % 64 AS k, m // 64 AS d2 FROM (
    SELECT p.rid, p.part, min(({d2}) * 64 + b.k) AS m FROM p JOIN {book} b ON b.part = p.part GROUP BY p.rid, p.part
  ) q"""


def _moved(near: str, book: str) -> str:
    mean = ", ".join(f"CAST(floor(CAST(sum(p.x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS x{i}" for i in range(4))
    new = ", ".join(f"coalesce(m.x{i}, b.x{i}) AS x{i}" for i in range(4))
    return f"""
  SELECT b.part, b.k, {new} FROM {book} b LEFT JOIN (
    SELECT n.part, n.k, {mean} FROM {near} n JOIN p ON p.rid = n.rid AND p.part = n.part GROUP BY n.part, n.k
  ) m ON m.part = b.part AND m.k = b.k"""


def _classes(words: int, percent: int) -> str:
    """Classes of documents linked by the similarity of their shingle sets."""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, {SPACE}) AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {words - 1}), ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) t(i)
  WHERE len(w) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT u, v FROM (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
  ) p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * k >= {percent} * (x.n + y.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.v FROM r JOIN e ON r.b = e.u
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


OP12 = _classes(3, 90)

# For vectors of 64 components, as in the given tables.
OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rid, t.part, {", ".join(f"v[4 * t.part + {i + 1}] AS x{i}" for i in range(4))} FROM v, unnest(range(0, 16)) t(part)
), b0 AS MATERIALIZED (SELECT part, rid AS k, x0, x1, x2, x3 FROM p WHERE rid < 64),
n0 AS MATERIALIZED ({_nearest("b0")}),
b1 AS MATERIALIZED ({_moved("n0", "b0")}),
n1 AS MATERIALIZED ({_nearest("b1")}),
b2 AS MATERIALIZED ({_moved("n1", "b1")}),
n2 AS MATERIALIZED ({_nearest("b2")}),
digest AS (
  SELECT sha256(string_agg(x0 || ',' || x1 || ',' || x2 || ',' || x3, ',' ORDER BY part, k)) AS codebooks_sha256 FROM b2
), coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d2) AS BIGINT) AS error FROM n2 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (rid), digest
"""

ORACLE = {
    "op1_fm_index_decontamination": OP1,
    "op4_typed_chat_parts": OP4,
    "op8_multi_index_hamming": OP8,
    "op12_size_aware_join": OP12,
    "op13_gnat_codes": OP13,
}
