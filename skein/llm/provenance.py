"""Source files that nobody wrote by hand in their repository.

Notices in a file's header, in which tools, packers and third-party projects
name themselves, label the training set and are hidden from the features: header
comments and a tool's opening statement are cut off before anything is measured.
A random forest on the rest (compression ratio, token entropy, identifier
lengths, comment density, the shapes of lines, and whether the path follows a
naming convention for such files) scores every file. Conventions in a path are
features and no marks: how much they tell is learned from the notices. No notice
ever names a file of bulk data; for these the label is their share of literals.

A file is marked by its own notice or by a score of at least ``threshold``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import forest
from skein.llm.files import path_extension, whole_files
from skein.llm.syntax import LANGUAGE_OF
from skein.runtime import Stage

#: Phrases in which tools say that they wrote a file.
GENERATED = re.compile(
    r"code generated by .*do not edit|@generated\b|this file (?:was|is) (?:automatically |auto-?)generated|autogenerated file|\bautogen:|machine-made by"
    r"|(?:generated|created|produced|emitted|built|compiled) (?:from|by|with) .*\b(?:do not|don't|never) (?:modify|edit|touch|change)|do not modify by hand|<auto-generated"
    r"|(?:manual|hand) edits (?:get|are|will be) (?:overwritten|lost)|changes will be (?:lost|overwritten)|generated by the protocol buffer compiler"
    r"|erzeugt von .*nicht (?:bearbeiten|ändern)|g[ée]n[ée]r[ée] (?:par|automatiquement)|generado (?:por|autom)|gerado (?:por|autom)|generato (?:da|autom)|自动生成|自動生成|автоматически|сгенерирован"
    r"|eslint-disable \*/\s*/\* tslint:disable|rust-\w*gen \d|rust-bindgen|#!\[allow\(non_camel_case_types|^#line \d+ \"[^\"]+\.[ly]\"",
    re.I | re.M,
)
#: Phrases under which copies of third-party code are kept.
VENDORED = re.compile(
    r"upstream: .*imported|copied (?:verbatim )?from upstream|copied verbatim|vendored from|permission (?:to use this copy|is hereby granted)|single-(?:file|header) library"
    r"|\w+ \w+ library, version \d|copyright \(c\) \d{4} the (?!authors of this)[\w ]+ contributors",
    re.I | re.M,
)
#: The banner that packers keep.
PACKED = re.compile(r"^/\*! .*(?:license|\(c\))", re.I | re.M)
#: Statements with which tools open what they write.
OPENING = re.compile(r"\s*(?:#line \d+ \"|#!\[allow\(non_camel_case_types[^\n]*|[\"']use strict[\"'];\s*Object\.defineProperty\(exports, [\"']__esModule[\"'][^\n]*|eval\(function\(p,a,c,k,e[^)]*\))")
#: Directories and name endings of generated, packed and third-party files.
DIRECTORIES = re.compile(r"(?:^|/)(?:_?vendor|third[-_]?party|node_modules|bower_components|site-packages|external|extern|deps|contrib|pods|subprojects|__generated__|generated|gen)/", re.I)
ENDINGS = re.compile(r"[._-](?:min|bundle|pack(?:ed)?)\.(?:js|jsx)$|\.(?:pb|pb\.gw|gen)\.go$|_pb2(?:_grpc)?\.py$|\.(?:tab|yy|lex)\.[ch]$|\.(?:g|generated|designer)\.\w+$|(?:^|/)bindings(?:_\w+)?\.rs$", re.I)
BODY = ("size", "ratio", "entropy", "name_length", "short_names", "comments", "literals", "digits", "longest", "line_length", "lines", "spaces", "distinct", "strings", "alike", "commonest", "underscores", "capitals", "braces", "parens", "ends", "assigns", "dots", "openers", "blank_lines")
PATH = ("conventions",)
FEATURES = (*BODY, *PATH)
#: Depth of the trees that find look-alikes of labelled files.
SHALLOW = 3
#: Share and number of characters in literals from which a body is labelled as bulk data.
BULK_SHARE, BULK_CHARACTERS = 0.6, 400

_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\w\s]")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|^\s*#(?!\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|undef|pragma|line)\b)[^\n]*", re.S | re.M)
_WORDS = re.compile(r"\w+")
_OPENER = re.compile(r"^[^\s#/}].*[{:]\s*$", re.M)
_HEAD = re.compile(r"\A(?:[ \t]*(?://[^\n]*|#[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\")?[ \t]*\r?(?:\n|\Z))*", re.S)


def split_header(text: str) -> tuple[str, str]:
    """The leading comments and blank lines of a file, and the rest."""
    text = text.removeprefix("﻿")
    at = _HEAD.match(text).end()
    return text[:at], text[at:]


def features(body: str) -> list[float]:
    """The ``BODY`` features of a body from which header and opening have been cut."""
    n = len(body)
    if not n:
        return [0.0] * len(BODY)
    bare = _COMMENT.sub("", body)
    tokens = _TOKEN.findall(bare)
    counts = Counter(tokens)
    total = max(1, len(tokens))
    entropy = -sum(c / total * log2(c / total) for c in counts.values())
    names = literals = short = length = strings = under = capital = 0
    for t, c in counts.items():
        first = t[0]
        if first.isalpha() or first == "_":
            names += c
            length += c * len(t)
            short += c * (len(t) <= 2)
            under += c * (first == "_")
            capital += c * (len(t) > 2 and t.isupper())
        elif first.isdigit():
            literals += c * (len(t) + 2)
        elif first in "\"'" and len(t) > 1:
            literals += c * (len(t) + 2)
            strings += c * len(t)
    raw = bare.encode("utf-8", "surrogatepass")
    lines = bare.split("\n")
    bare_lines = [x for x in map(str.strip, lines) if x]
    filled = [len(x) for x in lines if x.strip()] or [0]
    shapes = Counter(_WORDS.sub("a", x) for x in bare_lines)
    n_lines = max(1, len(bare_lines))
    size = max(1, len(bare))
    return [
        float(np.log1p(n)),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
        entropy,
        length / max(1, names),
        short / max(1, names),
        1 - len(bare) / n,
        min(1.0, literals / size),
        sum(map(bare.count, "0123456789")) / size,
        float(np.log1p(max(filled))),
        sum(filled) / len(filled),
        float(np.log1p(len(filled))),
        (bare.count(" ") + bare.count("\n") + bare.count("\t")) / size,
        len(counts) / total,
        strings / size,
        1 - len(shapes) / n_lines,
        max(shapes.values(), default=0) / n_lines,
        under / total,
        capital / total,
        *(counts[c] / total for c in "{(;=."),
        len(_OPENER.findall(bare)) / n_lines,
        (len(lines) - len(bare_lines)) / n_lines,
    ]


def place(path: str) -> list[float]:
    """The ``PATH`` feature: does the path follow a convention for files that are not written by hand?"""
    path = path.strip().replace("\\", "/").removeprefix("./")
    return [float(DIRECTORIES.search(path) is not None or ENDINGS.search(path) is not None)]


def evidence(path: str, text: str) -> tuple[str, list[float]]:
    """``(label, features)``; the label is empty where no notice is and the body is no bulk data."""
    head, body = split_header(text)
    opening = OPENING.match(body)
    if opening:
        body = body[opening.end() :]
    x = features(body) + place(path)
    if opening or GENERATED.search(head):
        return "generated", x
    if PACKED.search(head):
        return "packed", x
    if VENDORED.search(head):
        return "vendored", x
    bulk = x[BODY.index("literals")]
    if bulk >= BULK_SHARE and bulk * len(body) >= BULK_CHARACTERS:
        return "data", x
    return "", x


def measure(chunks: DataFrame) -> DataFrame:
    """``repo, relative_path, label, x`` for every file of a supported code extension; others are no cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r for r, _ in found], pa.string()), pa.array([x for _, x in found], pa.list_(pa.float64()))],
                names=["repo", "relative_path", "label", "x"],
            )

    code = chunks.where(path_extension(F.col("relative_path")).isin(*LANGUAGE_OF))
    return whole_files(code).mapInArrow(run, "repo string, relative_path string, label string, x array<double>")


def _sample(measured: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``sample_rows`` files at most, chosen by hash."""
    share = sample_rows / max(1, measured.count())
    rows = measured.select("label", "x") if share >= 1 else measured.where(F.xxhash64("repo", "relative_path") < int(share * 2**64) - 2**63).select("label", "x")
    got = rows.toPandas()
    return np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES)), (got["label"] != "").to_numpy(dtype=float)


def train(x: np.ndarray, y: np.ndarray, lift: float = 1.75) -> forest.Forest:
    """A forest on labelled and other files; others that look like labelled ones are no counter-examples and are left out.

    A look-alike is ``lift`` times as likely to be labelled as a file on average, by
    shallow trees, which cannot set apart a small kind of file of which no single one
    carries a notice.
    """
    doubt = lift * float(y.mean()) if len(y) else 0.0
    kept = np.ones(len(y), dtype=bool)
    for _ in range(3):
        alike = (y == 0) & kept & (forest.train(x[kept], y[kept], trees=30, depth=SHALLOW).predict(x) >= doubt)
        if not alike.any():
            break
        kept &= ~alike
    return forest.train(x[kept], y[kept])


def mark_files(chunks: DataFrame, sample_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """``repo, relative_path, label, score, marked`` for every code file.

    The forest is trained on at most about ``sample_rows`` files; every file is
    scored. A file is marked if a notice labels it or its score is ``threshold``
    or more; the label ``data`` alone marks nothing. An empty table gives an
    empty result.
    """
    measured = Stage(chunks.sparkSession, "provenance").save(measure(chunks))
    model = train(*_sample(measured, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.predict(x))], names=["repo", "relative_path", "label", "score"])

    scored = measured.mapInArrow(run, "repo string, relative_path string, label string, score double")
    return scored.withColumn("marked", ~F.col("label").isin("", "data") | (F.col("score") >= threshold))
