"""Personal data: exact patterns, and a linear-chain conditional random field.

The patterns give the base spans.  The random field works on the words of a text and
their shapes (digits, dots, signs, lengths, trigger words, those of the neighbours).
It is trained here by gradient ascent on the likelihood of a small labelled table,
and decoded by Viterbi in numpy batches.  Its spans that overlap no base span are
added.

Decoding is exact over whole texts.  A word whose lead for "outside" exceeds all that
transitions can gain is outside on the best path, so only the runs between such words
are decoded, many at a time.

The rows are independent: one pass, no shuffle; the model is broadcast (its size is
fixed by the feature list).

Defined results: null or empty text has no spans; repeated rows are treated alike;
an empty table gives no rows; columns other than ``carry`` are not read.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the lookbehind and the possessive repeats only save time: a match begins where its
# digits begin, since the one before it took all digits up to its end
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of kinds, then starts."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- word shapes
# Words that announce a kind.
TRIGGERS = {
    "secret": "token key secret password passwd passphrase apikey api_key api-key auth bearer credential",
    "phone": "tel phone call mobile fax telephone",
    "email": "mail email e-mail contact",
    "ip": "ip host server addr address",
    "card": "card visa mastercard credit debit",
}
TRIGGER = {w: f"trigger_{k}" for k, ws in TRIGGERS.items() for w in ws.split()}
EDGE = "\"'`.,;:!?()[]{}<>*#%&$|/\\"
FEATURES = [
    *("bias plain capital upper at dots plus round dash equals quote junk other").split(),
    *(f"digits_{n}" for n in ("1", "4", "5", "9", "13", "20")),
    *("decimal number hex mixed hidden_at").split(),
    *(f"trigger_{k}" for k in TRIGGERS),
]
NUMBER = {f: i for i, f in enumerate(FEATURES)}


LETTERS, CAPITAL, UPPER = (
    tuple(sorted(NUMBER[x] for x in ("bias", "plain", *more))) for more in ((), ("capital",), ("upper",))
)
SPECIAL = re.compile(r"[0-9@=+(\[\"'`]")


def shape(word: str) -> tuple[int, ...]:
    """The feature numbers of one word."""
    core = word.strip(EDGE)
    if core and not SPECIAL.search(word) and core.lower() not in TRIGGER:  # most words
        if core[0].islower() or not core[0].isupper():
            return LETTERS
        return UPPER if len(core) > 1 and core.isupper() else CAPITAL
    out = ["bias"]
    n = sum(c in "0123456789" for c in core)
    if "[at]" in core or "(at)" in core:
        out.append("hidden_at")
    if not core:
        out.append("equals" if word in (":", "=", ":=") else "junk")
    elif core.lower() in TRIGGER or core.rstrip("=").lower() in TRIGGER:
        out.append(TRIGGER.get(core.lower()) or TRIGGER[core.rstrip("=").lower()])
    elif core == "=":
        out.append("equals")
    elif not n and "@" not in core:
        out.append("plain")
        if core[0].isupper():
            out.append("upper" if len(core) > 1 and core.isupper() else "capital")
    else:
        low = core.lower()
        if "@" in core:
            out.append("at")
        if n:
            for limit in (20, 13, 9, 5, 4, 1):
                if n >= limit:
                    out.append(f"digits_{limit}")
                    break
        parts = low.split(".")
        if len(parts) == 4 and all(p.isdigit() for p in parts):
            out.append("dots")
        elif core.replace(".", "").replace(",", "").isdigit():
            out.append("number" if core.isdigit() else "decimal")
        if len(core) >= 16 and n and all(c in "0123456789abcdef" for c in low) and n < len(core):
            out.append("hex")
        elif len(core) >= 16 and n and core.replace("_", "").replace("-", "").isalnum() and not core.isdigit() and n < len(core) - 3:
            out.append("mixed")
        if "-" in core:
            out.append("dash")
        if len(out) == 2 and n:
            out.append("other")
    if word.startswith("+") and n:
        out.append("plus")
    if n and ("(" in word or ")" in word):
        out.append("round")
    if word[0] in "\"'`":
        out.append("quote")
    return tuple(sorted(NUMBER[x] for x in set(out)))


# ---------------------------------------------------------------- labelled table
def labelled_table(rows: int = 300, seed: int = 9) -> list[tuple[list[str], list[str]]]:
    """The training table: (words, labels) of short texts composed by rule from plain
    words, numbers that are nobody's, and data of every kind in common layouts."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    hexes = lambda n: "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, n))
    plain = (
        "the of and a report was read in house Monday River they with from, call. NOTE value, le maison der Haus "
        "casa que *** ### the%%% and&&& IN!! | at dot key address server contact card"
    ).split()
    nobody = ["3.", "4.0.", "2024", "12", "7,", "1999.", "3.14", "10%", "42###", "A4", "b12", "1,200", "12-14", "1st", "365", "(3)"]

    def word():
        return pick(nobody) if rng.random() < 0.15 else pick(plain)

    def email():
        name = pick(["ann", "bo.li", "k-w", "info"])
        if rng.random() < 0.4:
            return [f"{name}{pick(['[at]', '(at)'])}example{pick(['[dot]', '(dot)', '.'])}org"]
        return [f"{name}.{digits(2)}@mail{digits(1)}.example.com"]

    def ip():
        return [".".join(str(rng.integers(1, 255)) for _ in range(4))]

    def card():
        n = digits(16)
        return [n] if rng.random() < 0.5 else [n[k : k + 4] for k in range(0, 16, 4)]

    def phone():
        a = ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]
        return pick([a, a[1:], [f"+{digits(2)}", digits(3), digits(7)], [f"{digits(3)}-{digits(3)}-{digits(4)}"]])

    def secret():
        s = pick([hexes(40), hexes(32), "sk_live_" + hexes(24), "AKIA" + hexes(16).upper()])
        return [f'"{s}"' if rng.random() < 0.6 else s]

    lead = {
        "email": [[], ["mail"], ["email:"]],
        "ip": [[], ["ip"], ["host"]],
        "card": [["card"], ["visa"], ["credit", "card"]],
        "phone": [[], ["tel"], ["phone:"], ["call"]],
        "secret": [["token", "="], ["password", "="], ["api_key", "="], ["secret:"], ["key="]],
    }
    make = {"email": email, "ip": ip, "card": card, "phone": phone, "secret": secret}
    table = []
    for r in range(rows):
        words = [word() for _ in range(rng.integers(2, 7))]
        labels = ["O"] * len(words)
        kinds = [] if r % 4 == 0 else [pick(KINDS) for _ in range(1 + r % 2)]
        if r % 8 == 0:  # long numbers and hashes that nothing announces
            words.append(pick([digits(16), digits(13), digits(10), hexes(40)]))
            labels.append("O")
        for kind in kinds:
            before, found = pick(lead[kind]), make[kind]()
            if found[0].startswith("(") and kind == "phone" and not before:
                before = ["phone"]
            if rng.random() < 0.2:
                found[-1] += pick([".", ",", "!!", "###", "$$$"])
            words += [*before, *found]
            labels += ["O"] * len(before) + [f"{'I' if k else 'B'}-{kind}" for k in range(len(found))]
            more = [word() for _ in range(rng.integers(0, 4))]
            words += more
            labels += ["O"] * len(more)
        table.append((words, labels))
    return table


# ---------------------------------------------------------------- the random field
class Field:
    """Weights of a word's own, previous and next shape for every label, and of label
    pairs; both ends of a text count as outside."""

    def __init__(self, own, before, after, step) -> None:
        self.own, self.before, self.after, self.step = own, before, after, step
        # the most that the two transitions around a word gain by a label over "outside"
        self.bound = (step - step[:, :1]).max(axis=0) + (step - step[:1]).max(axis=1) + 1e-6


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table, rounds: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam."""
    n_f, n_l = len(FEATURES), len(LABELS)
    longest = max(len(w) for w, _ in table)
    x = np.zeros((len(table), longest + 2, n_f))
    y = np.zeros((len(table), longest), np.int64)
    size = np.array([len(w) for w, _ in table])
    for r, (words, labels) in enumerate(table):
        for k, w in enumerate(words):
            x[r, k + 1, list(shape(w))] = 1
        y[r, : len(labels)] = [LABELS.index(t) for t in labels]
    live = np.arange(longest)[None] < size[:, None]
    views = (x[:, 1:-1], x[:, :-2], x[:, 2:])
    gold = np.eye(n_l)[y] * live[..., None]
    prior = np.concatenate([np.zeros((len(table), 1), np.int64), y[:, :-1]], axis=1)
    weights = [np.zeros((n_f, n_l)) for _ in range(3)] + [np.zeros((n_l, n_l))]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    rows = np.arange(len(table))
    for t in range(1, rounds + 1):
        step = weights[3]
        emit = sum(v @ w for v, w in zip(views, weights, strict=False))
        forward = np.zeros((longest, len(table), n_l))
        forward[0] = emit[:, 0] + step[0]
        for k in range(1, longest):
            new = emit[:, k] + _log_sum(forward[k - 1][:, :, None] + step[None], 1)
            forward[k] = np.where(live[:, k, None], new, forward[k - 1])
        backward = np.zeros((longest, len(table), n_l))
        backward[longest - 1] = step[:, 0]
        for k in range(longest - 2, -1, -1):
            new = _log_sum(step[None] + (emit[:, k + 1] + backward[k + 1])[:, None, :], 2)
            backward[k] = np.where(live[:, k + 1, None], new, step[:, 0])
        total = _log_sum(forward[longest - 1] + step[:, 0], 1)
        chance = np.exp(forward.transpose(1, 0, 2) + backward.transpose(1, 0, 2) - total[:, None, None]) * live[..., None]
        rest = (gold - chance).reshape(-1, n_l)
        grads = [v.reshape(-1, n_f).T @ rest for v in views]
        pairs = np.zeros((n_l, n_l))
        np.add.at(pairs, (prior[live], y[live]), 1)
        np.add.at(pairs, (y[rows, size - 1], 0), 1)
        pairs[0] -= chance[:, 0].sum(axis=0)
        pairs[:, 0] -= chance[rows, size - 1].sum(axis=0)
        for k in range(1, longest):
            on = live[:, k]
            joint = forward[k - 1][on][:, :, None] + step[None] + (emit[on, k] + backward[k][on])[:, None, :]
            pairs -= np.exp(joint - total[on][:, None, None]).sum(axis=0)
        grads.append(pairs)
        for i, g in enumerate(grads):
            g = g / len(table) - decay * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] + rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Field(*weights)


@cache
def default_field() -> Field:
    return train(labelled_table())


def viterbi(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best label rows for a batch of runs of one length (batch, words, labels), each
    between two outside words."""
    n, size, _ = emit.shape
    back = np.zeros((n, size, emit.shape[2]), np.int64)
    score = emit[:, 0] + step[0]
    for k in range(1, size):
        ways = score[:, :, None] + step[None]
        back[:, k] = ways.argmax(axis=1)
        score = ways.max(axis=1) + emit[:, k]
    out = np.zeros((n, size), np.int64)
    out[:, -1] = (score + step[:, 0]).argmax(axis=1)
    for k in range(size - 1, 0, -1):
        out[:, k - 1] = back[np.arange(n), k, out[:, k]]
    return out


class Tagger:
    """Labels the words of many texts at once; shapes of words are remembered up to a
    bounded number of words."""

    def __init__(self, field: Field, remembered: int = 150_000) -> None:
        self.field, self.remembered = field, remembered
        self.shapes: dict[tuple, int] = {(): 0}  # number 0: beyond an end of the text
        self.words: dict[bytes, int] = {}
        n = len(LABELS)
        self.rows = [np.zeros((1, n)) for _ in range(3)]

    def _number(self, word: bytes) -> int:
        key = shape(word.decode())
        if key not in self.shapes:
            self.shapes[key] = len(self.shapes)
            for i, w in enumerate((self.field.own, self.field.before, self.field.after)):
                self.rows[i] = np.concatenate([self.rows[i], w[list(key)].sum(axis=0)[None]])
        return self.shapes[key]

    def labels(self, texts: list[list[bytes]]) -> dict[int, list[tuple[int, int]]]:
        """text number -> (word number, label) of the words that are not outside."""
        if len(self.words) > self.remembered:
            self.words.clear()
        known = self.words
        for words in texts:
            for w in set(words).difference(known):
                known[w] = self._number(w)
        sizes = np.array([len(w) for w in texts], np.int64)
        ids = np.zeros(int(sizes.sum() + len(texts)) + 1, np.int64)
        at = 1
        for words in texts:  # a 0 before and behind each text
            ids[at : at + len(words)] = [known[w] for w in words]
            at += len(words) + 1
        # for each (own, previous, next) shape: is the lead of "outside" beyond reach?
        n = len(self.shapes)
        triple, inverse = np.unique((ids[1:-1] * n + ids[:-2]) * n + ids[2:], return_inverse=True)
        emit = self.rows[0][triple // n // n] + self.rows[1][triple // n % n] + self.rows[2][triple % n]
        sure = (emit[:, :1] - emit > self.field.bound)[:, 1:].all(axis=1)
        sure |= triple // n // n == 0
        edge = np.diff(np.r_[0, (~sure[inverse]).view(np.int8), 0])
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        first = np.cumsum(sizes + 1) - sizes - 1
        out: dict[int, list[tuple[int, int]]] = {}
        for size in np.unique(end - begin):
            starts = begin[end - begin == size]
            for some in np.array_split(starts, 1 + len(starts) * size // 200_000):
                best = viterbi(emit[inverse[some[:, None] + np.arange(size)]], self.field.step)
                for r, k in zip(*np.nonzero(best), strict=True):
                    place = some[r] + k
                    text = int(owner[place])
                    out.setdefault(text, []).append((int(place - first[text]), int(best[r, k])))
        return {t: sorted(x) for t, x in out.items()}


def field_spans(text: str, labelled: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of consecutive words of one kind, without signs at their edges."""
    places = [m.span() for m in WORD.finditer(text)]
    groups: list[list] = []
    for k, label in labelled:
        prefix, kind = LABELS[label].split("-")
        if groups and prefix == "I" and groups[-1][0] == kind and groups[-1][2] == k - 1:
            groups[-1][2] = k
        else:
            groups.append([kind, k, k])
    out = []
    # what is called a card must pass the checksum, however its digits are set
    for kind, a, b in groups:
        start, end = places[a][0], places[b][1]
        while start < end and text[start] in EDGE and not (kind == "phone" and text[start] == "("):
            start += 1
        while end > start and text[end - 1] in EDGE and not (kind == "phone" and text[end - 1] == ")"):
            end -= 1
        digits = "".join(c for c in text[start:end] if c in "0123456789") if kind == "card" else ""
        if start < end and (kind != "card" or 13 <= len(digits) <= 19 and luhn(digits)):
            out.append((kind, start, end))
    return out


def find_personal_data(docs: DataFrame, carry: list[str], field: Field | None = None) -> DataFrame:
    """``carry`` columns with base and spans: arrays of (kind, start, end) in code
    points, by kind and start; spans holds base and what the field adds."""
    carry = [c for c in carry if c not in ("base", "spans")]
    kept = [docs.schema[c] for c in carry]
    span = "array<struct<kind:string,start:int,end:int>>"
    schema = T.StructType([*kept, *T.StructType.fromDDL(f"base {span}, spans {span}").fields])
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [list(x) for x in base]
            for lo in range(0, len(texts), 500):
                found = tagger.labels([t.encode().split() for t in texts[lo : lo + 500]])
                for k, labelled in found.items():
                    taken = [(a, b) for _, a, b in base[lo + k]]
                    new = [s for s in field_spans(texts[lo + k], labelled) if not any(s[1] < b and a < s[2] for a, b in taken)]
                    every[lo + k] = sorted(every[lo + k] + new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            columns = [
                pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in xs], kind_of) for xs in (base, every)
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *columns], names=schema.names)

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def span_list(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
