"""Personal data by candidate gradient boosting.

Generators with high recall propose spans that may overlap; boosted trees score
each from its format and context; a threshold per kind, calibrated on examples
that the trees did not see, selects. Spans of the fixed base patterns always stay.

No table labels personal data, so the trees learn from generated examples: values
in the usual formats and in look-alikes, among words of several kinds. They are
made from a seed, so every run and every executor has the same model.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import sliced

KINDS = ("email", "ip", "card", "phone")

# The base patterns (the lookbehind and possessive forms match the same
# spans as the plain ones, in linear time).
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Each @ takes the characters before it, back to the last match, and a dotted domain."""
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind's pattern that pass its test."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# Generators: wider than the base, and free to overlap it and each other.
_WIDE = {
    "email": [
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,63}){1,4}", re.I),
        re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} at [A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{2,63}){1,4}", re.I),
    ],
    "ip": [re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\.) ?[0-9]{1,3}){3}(?![0-9])")],
    "card": [re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"), re.compile(r"(?<![0-9])[0-9]{4}([ .-])[0-9]{6}\1[0-9]{5}(?![0-9])")],
    "phone": [
        re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"),
        re.compile(r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
        re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
        re.compile(r"(?<![0-9+])00[0-9]{1,3}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"),
    ],
}
_HINTS = {
    "email": re.compile(r"mail|contact|write|reach|correo|kontakt|courriel", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|client|ping", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell|ring|dial", re.I),
}
_AGAINST = re.compile(r"order|invoice|version|release|isbn|serial|ticket|token|hash|total|price|section|build|part|ref|batch|page", re.I)


def candidates(text: str) -> list[tuple[str, int, int]]:
    digit = bool(_DIGIT.search(text))
    found: set[tuple[str, int, int]] = set()
    for kind, patterns in _WIDE.items():
        if kind == "email":
            low = text.lower()
            tried = [p for p, need in zip(patterns, (("@", "at)", "at]", "at}"), (" dot ",)), strict=True) if any(n in low for n in need)]
        else:
            tried = patterns if digit else []
        for p in tried:
            found.update((kind, *m.span()) for m in p.finditer(text))
    return sorted(found)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    own, digits = text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    groups = re.findall(r"[0-9]+", own)
    marks = {c for c in own if not c.isalnum()}
    last = re.split(r"[^A-Za-z]+", own)[-1]
    return [
        float(len(own)),
        float(len(digits)),
        len(digits) / len(own),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        float(len(marks)),
        float("+" == own[:1]),
        float("(" in own),
        float("@" in own),
        float(bool(digits) and luhn(digits)),
        float(own[:1] == "0"),
        float(len(set(digits))),
        float(all(int(g) <= 255 for g in groups if len(g) < 5) and all(len(g) < 4 for g in groups)),
        float(before[-1:].isalnum()),
        float(bool(after) and (after[0].isalnum() or (after[0] in ".-@_" and after[1:].isalnum()))),
        float(before[-1:] in set(".-/#=_\"'") and before != ""),
        float(bool(_HINTS[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        float(2 <= len(last) <= 6),
        float(" at " in own.lower() and " dot " in own.lower()),
    ]


class Trees:
    """Boosted regression trees of depth three for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 3):
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.trees: list = []
        margin = np.full(len(y), self.prior)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            margin += np.array([self._leaf(tree, r) for r in x])

    def _grow(self, x, gradient, hessian, rows, depth, rate):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 10:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v = x[order, f]
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                gl, hl = np.cumsum(gradient[order])[cut], np.cumsum(hessian[order])[cut]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
        _, f, at = best
        if f is None:
            return rate * g / (h + 1)
        low = x[rows, f] <= at
        return (f, at, self._grow(x, gradient, hessian, rows[low], depth - 1, rate), self._grow(x, gradient, hessian, rows[~low], depth - 1, rate))

    @staticmethod
    def _leaf(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def probability(self, row: list[float]) -> float:
        return float(1 / (1 + np.exp(-(self.prior + sum(self._leaf(t, row) for t in self.trees)))))


def _examples(kind: str, n: int, rng: random.Random) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): values of a kind, and look-alikes, in contexts."""

    def number(k):
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word(a=2, b=9):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))

    def card(k=16):
        body = rng.choice("3456") + number(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def not_card(k):
        while luhn(body := number(k)):
            pass
        return body

    byte = lambda: str(rng.randint(1, 254))
    tld = lambda: rng.choice(["com", "org", "net", "edu", "io", "de", "fr", "es"])
    sep = rng.choice
    yes = {
        "email": [lambda: f"{word()}{rng.choice(['', '.' + word(), number(2)])}@{word()}.{tld()}", lambda: f"{word()}.{number(2)}@{word()}{number(1)}.{word()}.{tld()}", lambda: f"{word()} (at) {word()}.{tld()}", lambda: f"{word()} at {word()} dot {tld()}", lambda: f"{word()} @ {word()}.{tld()}", lambda: f"{word()}[at]{word()}[dot]{tld()}"],
        "ip": [lambda: ".".join(byte() for _ in range(4)), lambda: "[.]".join(byte() for _ in range(4))],
        "card": [lambda: card(), lambda: (lambda c, s: s.join(c[i : i + 4] for i in range(0, 16, 4)))(card(), sep(" -.")), lambda: (lambda c, s: s.join((c[:4], c[4:10], c[10:])))(card(15), sep(" -")), lambda: card(rng.choice([13, 15, 19]))],
        "phone": [lambda: f"+{rng.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"+{rng.randint(1, 99)} {number(3)} {number(3)} {number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"00{rng.randint(10, 99)} {number(3)} {number(3)} {number(3)}", lambda: f"+{rng.randint(10, 99)}{number(9)}"],
    }
    no = {
        "email": [lambda: f"{word()} at {word()} dot {word(7, 9)}", lambda: f"{word()}@{word()}.{number(2)}", lambda: f"{word()} @ {word()}.{word(8, 9)}"],
        "ip": [lambda: ".".join(number(3) for _ in range(4)), lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}. {rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: f"{rng.randint(300, 999)}.{byte()}.{byte()}.{byte()}"],
        "card": [lambda: not_card(rng.randint(13, 19)), lambda: not_card(16), lambda: (lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4)))(not_card(16)), lambda: card(rng.choice([14, 17, 18]))],
        "phone": [lambda: f"{number(3)}.{number(3)}.{number(4)}", lambda: f"{number(3)} {number(3)} {number(4)}", lambda: f"00{number(3)}{number(8)}", lambda: f"{number(3)}-{number(3)}-{number(4)}"],
    }
    hint = {"email": ["mail", "contact", "write to"], "ip": ["server", "host", "ip"], "card": ["card", "visa", "payment"], "phone": ["call", "tel", "phone"]}
    against = ["order", "version", "invoice", "serial", "ticket", "token =", "build", "part"]
    out = []
    for i in range(n):
        label = i % 2
        value = rng.choice((yes if label else no)[kind])()
        roll = rng.random()
        if label:
            lead = rng.choice(hint[kind]) if roll < 0.3 else word()
        else:
            lead = rng.choice(against) if roll < 0.5 else word()
        left, right = " ", rng.choice([" ", ". ", ", ", ""])
        if not label and rng.random() < 0.3:
            left, right = rng.choice([" #", " \"", "-", "/"]), rng.choice(["-", "/", "\"", "."]) + number(2)
        text = f"{word()} {lead}{left}{value}{right}{word()}"
        at = len(text) - len(text.rpartition(value)[2]) - len(value)
        out.append((text, at, at + len(value), label))
    return out


@cache
def model(seed: int = 7, examples: int = 1200, precision: float = 0.98) -> dict[str, tuple[Trees, float]]:
    """Trees and threshold of each kind.

    Of the generated examples two thirds train; on the rest the threshold is the
    least score from which on at least ``precision`` of the examples are personal
    data, and one half at least.
    """
    out = {}
    for kind in KINDS:
        rows = _examples(kind, examples, random.Random(f"{seed}:{kind}"))
        x = np.array([features(t, kind, a, b) for t, a, b, _ in rows])
        y = np.array([float(r[3]) for r in rows])
        seen = np.arange(len(rows)) % 6 < 4
        trees = Trees(x[seen], y[seen])
        p = np.array([trees.probability(r) for r in x[~seen]])
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(y[~seen][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(share >= precision)
        out[kind] = (trees, max(0.5, float(p[order][good[-1]]) if len(good) else 1.0))
    return out


def _union(spans: Iterable[Span]) -> list[Span]:
    """What the spans cover, as spans in order that share no letter."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _meets(taken: list[Span], a: int, b: int) -> bool:
    """Whether [a, b) overlaps one of ``taken``, which are in order and share no letter."""
    at = bisect_left(taken, (b,))
    return at > 0 and taken[at - 1][1] > a


def find(text: str | None, trees: dict[str, tuple[Trees, float]] | None = None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans of each kind, in order of their start.

    A selected candidate is added where it overlaps no base span of any kind and
    no better candidate: of two that overlap the likelier one, then the longer, then
    the one that starts first. A text with n spans takes n log n, however long it is.
    """
    base = base_spans(text or "")
    every = {k: list(v) for k, v in base.items()}
    if not text:
        return base, every
    taken = _union(s for v in base.values() for s in v)
    scored = []
    for kind, a, b in candidates(text):
        if _meets(taken, a, b):
            continue
        own, least = (trees or model())[kind]
        if (p := own.probability(features(text, kind, a, b))) >= least:
            scored.append((-p, a - b, a, b, kind))
    for _, _, a, b, kind in sorted(scored):
        if not _meets(taken, a, b):
            insort(taken, (a, b))
            every[kind].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets."""
    if text is None:
        return None
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, v in find(text)[1].items() for a, b in v):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _finder(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model(seed)
        for batch in sliced(batches):
            found = [find(t, trees) for t in batch.column(1).to_pylist()]
            counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_joined(e) for _, e in found], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find_pii(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans per row.

    Positions are code points, ends exclusive. Null texts are empty and have no
    span; other columns are ignored, rows that repeat are read each. An empty table
    gives an empty one, very long texts are read whole and ties are settled as in ``find``.
    Nothing is shuffled: a row's answer needs its text only.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_finder(seed), schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of text replaced by their kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
