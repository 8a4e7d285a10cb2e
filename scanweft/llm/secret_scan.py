"""Secret scans (operator 5): patterns, and an assignment-aware lexer.

`assignments` parses source code and configuration syntax into names and the literals that reach them, with constants
followed through names. A literal is reported when the name it reaches is sensitive and its own form is not that of a
placeholder or a plain word. The score of joined literals follows from traits of the parts, so neither the number of
literals nor that of names on the way is limited, and work grows with the text.

Texts go through it whole. Bytes that no pattern can do without (a separator, AKIA, a run of 16 hex
digits) are looked for in the buffer of all texts first, and only texts that hold a part of a sensitive name are lexed.

Defined results: a null text is empty; very long texts are lexed whole; an empty table gives no rows; repeated rows
each get their result; null ids stay; spans that tie in place are told by kind; other columns, of whatever name, are
ignored (kept by `redact`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanweft.llm.assignments import Expression, assignments
from scanweft.llm.shared import arrow_rows, bound_batches, buffer_of, column, plain, steps, texts

KINDS = ["assign", "access", "hex", "literal"]
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these stands in every assignment.
_PAIRING = np.zeros(256, bool)
_PAIRING[list(b"=:(<")] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[list(b"0123456789abcdef")] = True

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How strongly a word of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5}
#: Words that make a following "key" secret.
KEY_BEFORE = {"api", "access", "private", "signing", "encryption", "auth", "account", "master", "shared", "client", "service"}
#: What stands for a secret without being one.
PLACEHOLDERS = {"password", "passwd", "secret", "token", "changeme", "example", "placeholder", "none", "null", "true", "false", "undefined", "todo", "redacted", "required", "optional", "string", "your", "test", "dummy", "sample"}
LEAST_SCORE = 0.5
#: What every sensitive name holds a part of.
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "salt")
_ODD = re.compile(r"\s|\$\{|\{\{|%\(")
_THREE = re.compile(r"[0-9]{3}")
#: Characters kept of each end of a literal: more than any placeholder has.
_EDGE = max(map(len, PLACEHOLDERS)) + 3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int


def name_score(name: str) -> float:
    """How sensitive a target name is, from 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((SENSITIVE.get(w, 0.0) or SENSITIVE.get(w.removesuffix("s"), 0.0) for w in words), default=0.0)
    for before, after in zip(words, words[1:], strict=False):
        if after in ("key", "keys") and before in KEY_BEFORE:
            best = max(best, 1.0)
    return 0.2 * best if words and words[-1] in ("id", "name", "url", "path", "file", "length", "count", "type", "expiry") else best


class Traits(NamedTuple):
    """What the score of a literal depends on; those of a join follow from its parts', so long ones are never built."""

    n: int
    counts: dict[str, int]  # in order of first places
    odd: bool  # holds what no secret does
    three: bool  # holds three digits in a row
    inner: bool  # holds a placeholder's word that touches neither end
    head: str
    tail: str


def traits(value: str) -> Traits:
    inner = any(m.start() and m.end() < len(value) and m.group().lower() in PLACEHOLDERS for m in _WORDS.finditer(value))
    return Traits(len(value), Counter(value), bool(_ODD.search(value)), bool(_THREE.search(value)), inner, value[:_EDGE], value[-_EDGE:])


def traits_of_join(a: Traits, b: Traits) -> Traits:
    if not a.n or not b.n:
        return a if a.n else b
    counts = dict(a.counts)
    for c, n in b.counts.items():
        counts[c] = counts.get(c, 0) + n
    seam = a.tail + b.head
    # a word that touches an end of the seam is longer than any placeholder, seen before, or no inner one
    inner = a.inner or b.inner or any(m.start() and m.end() < len(seam) and m.group().lower() in PLACEHOLDERS for m in _WORDS.finditer(seam))
    return Traits(a.n + b.n, counts, a.odd or b.odd or bool(_ODD.search(a.tail[-1] + b.head[0])), a.three or b.three or bool(_THREE.search(a.tail[-2:] + b.head[:2])), inner, (a.head + b.head)[:_EDGE] if a.n < _EDGE else a.head, (a.tail + b.tail)[-_EDGE:] if b.n < _EDGE else b.tail)


def _has_placeholder(t: Traits) -> bool:
    if t.inner:
        return True
    if t.n <= _EDGE:
        return any(w.lower() in PLACEHOLDERS for w in _WORDS.findall(t.head))
    first = (m.group() for m in _WORDS.finditer(t.head) if not m.start() and m.end() < _EDGE)
    last = (m.group() for m in _WORDS.finditer(t.tail) if m.start() and m.end() == _EDGE)
    return any(w.lower() in PLACEHOLDERS for w in (*first, *last))


def traits_score(t: Traits) -> float:
    """How much a literal looks like a secret of any kind, from 0 to 1: length, spread of characters, mixture."""
    n, counts = t.n, t.counts
    if n < 8 or t.odd or t.head[0] in "$<" or counts.keys() <= {"x", "X"} or counts.keys() in ({"*"}, {"."}):
        return 0.0
    if not t.three and _has_placeholder(t):
        return 0.0
    spread = -sum(p * math.log2(p) for c in counts.values() if (p := c / n))  # a share can be too small for a float
    classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "" for c in counts})
    if classes == 1 and not all(c.isdigit() for c in counts):
        return 0.45 if spread < 3.5 or n < 20 else 0.7
    return min(1.0, 0.25 + spread / 6 + 0.1 * (classes - 1) + 0.1 * (n >= 16))


def literal_score(value: str) -> float:
    return traits_score(traits(value))


def traits_of(expression: Expression, text: str) -> Traits:
    """Of all its literals, joined. Each expression is worked out once; a name that leads back to itself adds nothing."""
    waiting = [expression]
    while waiting:
        now = waiting[-1]
        if now.known is None and not now.open:
            now.open = True
            if before := [p for p in now.parts if isinstance(p, Expression) and p.known is None and not p.open]:
                waiting += before
                continue
        waiting.pop()
        if now.known is None:
            own = (p.known or traits("") if isinstance(p, Expression) else traits(text[p[0] : p[1]]) for p in now.parts)
            now.known = reduce(traits_of_join, own, traits(""))
    return expression.known


def alternatives(value: Expression) -> Iterator[Expression]:
    """Each of the expressions that a name may stand for."""
    waiting, met = [value], set()
    while waiting:
        now = waiting.pop()
        if id(now) in met:
            continue
        met.add(id(now))
        if now.options:
            waiting += [p for p in now.parts if isinstance(p, Expression)]
        else:
            yield now


def lexed(text: str) -> list[Span]:
    """Literals that reach a sensitive name, however many there are."""
    low = text.lower()
    if not any(stem in low for stem in _STEMS):
        return []
    found: dict[tuple[int, int], Span] = {}
    for name, value in assignments(text):
        sure = name_score(name)
        for own in alternatives(value) if sure else ():
            if sure * traits_score(traits_of(own, text)) >= LEAST_SCORE:
                for start, end in own.literals():
                    if end > start:
                        found[start, end] = Span("literal", start, end, start)
    return sorted(found.values(), key=lambda s: (s.start, s.end))


def base_spans(text: str, hexadecimal: bool = True) -> list[Span]:
    out = [Span("assign", m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [Span("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [Span("hex", m.start(), m.end(), m.start()) for m in _LONG_HEX.finditer(text)] if hexadecimal else []
    return out


def spans_of(batch: pa.Array) -> dict[int, list[Span]]:
    """The spans of each text that has any, by row, in order of start and kind."""
    raw, offsets = buffer_of(batch)
    n = len(offsets) - 1

    def rows(at: np.ndarray) -> set[int]:
        return set(np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist())

    paired = rows(np.flatnonzero(_PAIRING[raw]))
    keys = rows(np.flatnonzero((raw[:-3] == ord("A")) & (raw[1:-2] == ord("K")) & (raw[2:-1] == ord("I")) & (raw[3:] == ord("A")))) if len(raw) > 3 else set()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], _HEX_BYTE[raw].view(np.int8), [0]])))
    runs = edge[1::2] - edge[::2] >= 16
    first, last = (np.searchsorted(offsets, x, side="right") - 1 for x in (edge[::2][runs], edge[1::2][runs] - 1))
    digits = {i for a, b in zip(first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1)}  # a run may cross into the next text
    order = {k: i for i, k in enumerate(KINDS)}
    out = {}
    for i in sorted(paired | keys | digits):
        if i < n:
            text = batch[i].as_py() or ""
            spans = base_spans(text, i in digits) + (lexed(text) if i in paired else [])
            if spans:
                out[i] = sorted(spans, key=lambda s: (s.start, order[s.kind], s.end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with the values of all spans, merged where they overlap, replaced."""
    out, at = [], 0
    for start, end in sorted((s.value_start, s.end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
_DIGEST = {"doc_id": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_literal": pa.int64()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each kind, the checksum of the base spans and all spans, for every document."""
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            found = spans_of(step.column(1))
            n = {k: np.zeros(step.num_rows, np.int64) for k in KINDS}
            sha, spans = [none] * step.num_rows, [""] * step.num_rows
            for i, own in found.items():
                for s in own:
                    n[s.kind][i] += 1
                sha[i] = hashlib.sha256(joined([s for s in own if s.kind != "literal"]).encode()).hexdigest()
                spans[i] = joined(own)
            yield arrow_rows({"doc_id": step.column(0), "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": sha, "spans": spans, "n_literal": n["literal"]}, _DIGEST)

    return texts(docs, column(id_col).cast("long").alias("doc_id"), text=text_col).mapInArrow(run, DIGEST)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col replaced; texts without any, and null texts, stay as they are."""
    bound_batches(docs.sparkSession)
    rows, (own_text,) = plain(docs, text_col)
    at = rows.columns.index(own_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, own_text):
            column = step.column(at)
            found = spans_of(column)
            if found:
                cleaned = column.to_pylist()
                for i, own in found.items():
                    cleaned[i] = redacted(cleaned[i], own)
                step = step.set_column(at, step.schema.field(at), pa.array(cleaned, column.type))
            yield step

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
