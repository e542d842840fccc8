"""License scan with fuzzy search for short notices.

Exact phrases are counted on the word sequence.  For each notice, ``errors`` edits are
allowed: the notice is split into ``errors + 1`` pieces, at least one of which an
occurrence must hold unchanged (pigeonhole).  One automaton finds all pieces, each
hit fixes a window of the text, and the regex library's bounded-error matching
verifies the window and reports the span and its edits.  Windows are joined only if
they can be of one occurrence, so that each has a search of its own; of overlapping
spans of a notice, the one of the fewest edits stays.

The rows are independent: one pass, no shuffle, the notices are a fixed list.

Defined results: null or empty text has no words, no spans, empty labels and score
0; repeated rows are treated alike; columns other than ``carry`` are not read.
"""

from __future__ import annotations

from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vantage.llm.common import ALNUM_TABLE

# Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening words of public license notices, label, allowed edits.
NOTICES = [
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gpl", 6),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("licensed under the apache license version", "apache", 3),
    ("apache license version 2 0", "apache", 2),
    ("creative commons attribution", "cc-by", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("released under the mit license", "mit", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 5),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 5),
]
RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<label:string,start:int,end:int,edits:int>>"
)


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    edges = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Scanner:
    def __init__(self) -> None:
        import ahocorasick
        import regex

        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, _, errors) in enumerate(NOTICES):
            for offset, piece in pieces(notice, errors):
                seeds.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(t, literal_spaces=True)}){{e<={e}}}") for t, _, e in NOTICES]

    def base(self, padded: str) -> tuple[int, int | None, int | None, set[str]]:
        """Places, first and last start (in characters) and labels of the phrases."""
        n, first, last, labels = 0, None, None, set()
        for phrase, label in PHRASES.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                n += 1
                labels.add(label)
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
                at = padded.find(f" {phrase} ", at + 1)
        return n, first, last, labels

    def fuzzy(self, padded: str) -> list[tuple[str, int, int, int, float]]:
        """label, start, end, edits, similarity of verified notices, in order."""
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(padded):
            for n, offset in places:
                begins.setdefault(n, set()).add(max(0, end - size + 1 - offset - NOTICES[n][2]))
        found = []
        for n, own in begins.items():
            notice, label, errors = NOTICES[n]
            windows: list[list[int]] = []
            for begin in sorted(own):
                # the pieces of one occurrence give begins that differ by 2 * errors at most
                if windows and begin <= windows[-1][0] + 2 * errors:
                    windows[-1][1] = begin
                else:
                    windows.append([begin, begin])
            spans = set()
            for first, last in windows:
                m = self.patterns[n].search(padded, first, min(last + len(notice) + 3 * errors, len(padded)))
                if m:
                    spans.add((sum(m.fuzzy_counts), m.start(), m.end()))
            kept: list[tuple[int, int]] = []  # disjoint, in order
            for edits, a, b in sorted(spans):
                k = bisect(kept, (a, b))
                if (not k or kept[k - 1][1] <= a) and (k == len(kept) or b <= kept[k][0]):
                    kept.insert(k, (a, b))
                    found.append((label, a, b, edits, 1 - edits / len(notice)))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode().translate(ALNUM_TABLE).split()
        padded = f" {b' '.join(words).decode()} " if words else ""
        n, first, last, base = self.base(padded)
        found = self.fuzzy(padded)
        return {
            "n_words": len(words),
            "n_base": n,
            "first_word": None if first is None else padded.count(" ", 0, first),
            "last_word": None if last is None else padded.count(" ", 0, last),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {x[0] for x in found})),
            "score": 1.0 if base else max((x[4] for x in found), default=0.0),
            "notices": [
                {"label": a, "start": padded.count(" ", 1, b + 1), "end": padded.count(" ", 1, c) + 1, "edits": e}
                for a, b, c, e, _ in found
            ],
        }


def scan_licenses(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns with the counts, labels, score and notices (label, word
    range, edits) of each whole text."""
    result = T.StructType.fromDDL(RESULT)
    carry = [c for c in carry if c not in result.names]
    kept = [docs.schema[c] for c in carry]
    schema = T.StructType([*kept, *result.fields])
    notice = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(notice)]

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carry),
                    *(pa.array([r[n] for r in rows], t) for n, t in zip(result.names, types, strict=True)),
                ],
                names=schema.names,
            )

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
