"""Cutting oversized texts at the breaks of their own structure.

A text is seen as a tree: sections under headings (by level), blocks between
blank lines (a fenced block is one), list items and lines, sentences, words,
single tokens. Only nodes over the limit are opened; the parts of an opened node
are merged again, siblings first, while they fit. Each piece begins with the last
tokens of the piece before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import tokens as tok

_PIECES = "doc_id long, piece int, start long, body_start long, stop long, n_tokens long, cut string, text string"
_FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*\n?", re.M | re.S)
_HEADING = re.compile(r"^(#{1,6})[ \t]+\S|^(?=[^\n]*\S[^\n]*\n(=+|-{3,})[ \t]*$)", re.M)
_MARKUP = re.compile(r"^[ \t]*<(?:h[1-6]|section|article|div|table|ul|ol|p|pre)\b", re.M | re.I)
_BLANK = re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+(?=\S|[ \t]+\S|\Z)")
_DEFINITION = re.compile(r"^(?=(?:export |public |private |pub(?:\(\w+\))? |async |static )*(?:def|class|func|fn|function|impl|struct|interface|type|enum)\b)", re.M)
_ITEM = re.compile(r"^(?=(?:[-*+>]|\d+[.)])[ \t])", re.M)
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?;:])[ \t]+")
_WORD = re.compile(r"\s+")
LEVELS = ("heading", "markup", "definition", "block", "item", "line", "sentence", "word")


def breaks(text: str, level: str) -> list[int]:
    """Offsets inside ``text`` at which a new node of ``level`` begins."""
    if level == "heading":
        hidden = [m.span() for m in _FENCE.finditer(text)]
        found = [(len(m[1]) if m[1] else (1 if m[2] and m[2][0] == "=" else 2), m.start()) for m in _HEADING.finditer(text)]
        found = [(d, at) for d, at in found if not any(a < at < b for a, b in hidden)]
        top = min((d for d, at in found if at), default=0)
        return [at for d, at in found if d == top and at]
    if level in ("markup", "definition", "item"):
        pattern = {"markup": _MARKUP, "definition": _DEFINITION, "item": _ITEM}[level]
        return [m.start() for m in pattern.finditer(text) if m.start()]
    pattern = {"block": _BLANK, "line": _LINE, "sentence": _SENTENCE, "word": _WORD}[level]
    cuts = [m.end() for m in pattern.finditer(text) if 0 < m.end() < len(text)]
    if level == "block":
        hidden = [m.span() for m in _FENCE.finditer(text)]
        cuts = [c for c in cuts if not any(a < c < b for a, b in hidden)]
    return cuts


class _Text:
    """Token counts of any span of one text, from the offsets of its tokens."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.ids = tok.encode(path, text)
        sizes = [len(b) for b in map(tok.encoding(path).decode_single_token_bytes, self.ids)]
        ends = list(accumulate(sizes))
        if text.isascii():
            self.ends = ends
        else:  # byte offsets to the number of characters that are complete there
            raw = text.encode("utf-8")
            chars = list(accumulate((b & 0xC0) != 0x80 for b in raw))
            last = len(raw)
            self.ends = [chars[e - 1] if e == last or (raw[e] & 0xC0) != 0x80 else chars[e - 1] - 1 for e in ends]

    def weight(self, a: int, b: int) -> int:
        from bisect import bisect_left, bisect_right

        return bisect_left(self.ends, b) - bisect_right(self.ends, a) + 1 if b > a else 0


def _pack(t: _Text, a: int, b: int, level: int, limit: int) -> list[tuple[int, int, str]]:
    """Spans of at most ``limit`` tokens that cover ``[a, b)``, with the level of the cut before each."""
    if t.weight(a, b) <= limit:
        return [(a, b, "")]
    for k in range(level, len(LEVELS)):
        cuts = [a + c for c in breaks(t.text[a:b], LEVELS[k])]
        if not cuts:
            continue
        merged: list[tuple[int, int, str]] = []
        again = k if LEVELS[k] == "heading" else k + 1
        for x, y in pairwise([a, *cuts, b]):
            inner = _pack(t, x, y, again, limit)
            first = inner[0]
            if merged and len(inner) == 1 and t.weight(merged[-1][0], y) <= limit:
                merged[-1] = (merged[-1][0], y, merged[-1][2])
            else:
                merged += [(first[0], first[1], LEVELS[k] if merged else ""), *inner[1:]]
        return merged
    from bisect import bisect_right

    out, at = [], a
    while at < b:  # one unbroken run: cut between tokens
        i = bisect_right(t.ends, at)
        end = min(b, t.ends[min(i + limit - 1, len(t.ends) - 1)])
        end = end if end > at else min(b, at + 1)
        out.append((at, end, "token" if out else ""))
        at = end
    return out


def split(text: str, limit: int, overlap: int, path: str = tok.VOCABULARY) -> list[tuple[int, int, int, int, str]]:
    """``(start, body_start, stop, n_tokens, cut)`` of the pieces of one text.

    The bodies follow each other and cover the text; ``start`` lies the last
    ``overlap`` tokens of the piece before the body. No piece, its overlap
    included, has more than ``limit`` tokens when it is encoded by itself. A text
    within the limit is one piece; an empty one gives none.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError(f"an overlap of {overlap} leaves too little of a limit of {limit}")
    if not text:
        return []
    t = _Text(path, text)
    if len(t.ids) <= limit:
        return [(0, 0, len(text), len(t.ids), "")]
    todo = _pack(t, 0, len(text), 0, limit - overlap - 4)[::-1]
    out: list[tuple[int, int, int, int, str]] = []
    before: list[int] = []
    while todo:
        a, b, cut = todo.pop()
        start = a - len(_tail(path, text[out[-1][0] : a], before, overlap)) if out and overlap else a
        ids = tok.encode(path, text[start:b])
        if len(ids) > limit and b - a > 1:  # encoded apart it is longer: give the end away
            allowed = max(1, (b - a) * (limit - overlap) // max(len(ids), 1) // 2)
            inner = [c for c in breaks(text[a:b], "word") if c <= max(allowed, (b - a) // 2)]
            m = a + (inner[-1] if inner else max(1, (b - a) // 2))
            todo += [(m, b, "word" if inner else "token"), (a, m, cut)]
            continue
        out.append((start, a, b, len(ids), cut))
        before = ids
    return out


def _tail(path: str, text: str, ids: list[int], n: int) -> str:
    """The last ``n`` tokens of ``text`` as text; a character that the cut would divide is kept whole."""
    raw = tok.encoding(path).decode_bytes(ids[-n:])
    while raw and raw[0] & 0xC0 == 0x80:
        raw = raw[1:]
    return raw.decode("utf-8", "ignore") if text else ""


def split_all(documents: DataFrame, limit: int, overlap: int, path: str = tok.VOCABULARY) -> DataFrame:
    """The pieces of all ``documents(doc_id, text)`` with their text; null ids and null or empty texts give none."""
    tok.ship(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "piece", "start", "body_start", "stop", "n_tokens", "cut", "text"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, i, s, b, e, n, c, text[s:e]) for i, (s, b, e, n, c) in enumerate(split(text, limit, overlap, path))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)
