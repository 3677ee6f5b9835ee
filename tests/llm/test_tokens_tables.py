import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import mixing as M
from skein.llm import packing as P
from skein.llm import splitting as S
from skein.llm import tokens as T

SIZED = "doc_id long, n_tokens long, source string"


def optimum(sizes, cap):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= cap:
                bins[b] += sizes[i]
                place(i + 1, bins)
                bins[b] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_is_never_above_the_optimum(sizes):
    bound = P.lower_bound(np.bincount(sizes, minlength=21), 20)
    where, free = P.best_fit_decreasing(np.array(sizes), 20)
    assert bound <= optimum(sizes, 20) <= len(free)
    assert all(20 - sum(s for s, w in zip(sizes, where) if w == b) == f >= 0 for b, f in enumerate(free))


def test_packing_keeps_all_and_exchanges(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 300, 700, 900, 1100]), "s") for i in range(3000)] + [(9001, 5000, "s"), (9002, 0, "s"), (9003, None, "s"), (None, 5, "s")]
    df = spark.createDataFrame(rows, SIZED).selectExpr("*", "1 as part", "2 as bin")
    packed = P.pack(df, 2048, part_items=400).collect()
    used, per = defaultdict(int), defaultdict(int)
    for r in packed:
        used[r["container_id"]] += r["n_tokens"]
        per[r["doc_id"]] += r["n_tokens"]
    assert max(used.values()) <= 2048
    assert dict(per) == {a: b for a, b, _ in rows if a is not None and b}
    assert sorted(r["n_tokens"] for r in packed if r["doc_id"] == 9001) == [904, 2048, 2048]
    rep = P.report(df, P.pack(df, 2048, part_items=400), 2048).first()
    assert rep["lower_bound"] <= rep["containers"] <= rep["lower_bound"] * 1.03
    assert P.pack(df.limit(0), 2048).collect() == []


def test_mixing_meets_shares_caps_repeats_and_follows_the_schedule(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50, 400), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 40)] + [(5000, 10, None), (5001, None, "big"), (None, 9, "big")]
    df = spark.createDataFrame(rows, SIZED)
    targets = spark.createDataFrame([("Big ", 0.5, 1), ("mid", 0.3, 2), ("SMALL", 0.15, 4), ("gone", 0.05, 3), (None, 0.1, 1)], "source string, target_share double, max_repeat int")
    plan = M.plan(df, targets)
    mixed = M.mix(df, plan, bucket_rows=16)
    got = mixed.collect()
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    share = {r["source"]: r for r in M.shares(mixed, plan).collect()}
    for s, want in (("big", 0.5 / 0.95), ("mid", 0.3 / 0.95), ("small", 0.15 / 0.95)):
        assert abs(share[s]["actual_share"] - want) < 0.01 and share[s]["most_copies"] <= share[s]["max_repeat"]
    assert share["gone"]["tokens"] == 0
    p = {r["source"]: r for r in plan.collect()}
    assert abs(sum(r["share"] * r["tilt"] for r in p.values() if r["share"])) < 1e-9
    for s in ("big", "mid"):  # tokens before the middle of training follow the integrated weight
        half = p[s]["budget"] / 2
        before = sum(r["n_tokens"] for r in got if r["source"] == s and r["position"] < half)
        assert math.isclose(before, p[s]["demand"] * (0.5 - p[s]["tilt"] / 4), rel_tol=0.05)
    assert M.mix(df.limit(0), M.plan(df.limit(0), targets)).collect() == []


TEXTS = [
    "# A\n\n" + "word and more. " * 400 + "\n\n## B\n\n" + "\n".join(f"- item {i} of the list" for i in range(300)) + "\n\n# C\n\n```py\n# no heading\n" + "x = 1\n" * 200 + "```\n",
    "é漢字🙂" * 900,
    "x" * 9000,
    "\r\n\r\n".join("line one\r\nline two" for _ in range(300)),
    " " * 5000,
    "def f():\n    return 1\n\n" * 300,
]


def check(text, limit, overlap):
    pieces = S.split(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e, _, _ in pieces) == text
    for s, b, e, n, _ in pieces:
        assert n == len(T.encode(T.VOCABULARY, text[s:e])) <= limit and s <= b < e
    for (s0, _, e0, _, _), (s, b, _, _, _) in zip(pieces, pieces[1:]):
        tail = T.encoding(T.VOCABULARY).decode_bytes(T.encode(T.VOCABULARY, text[s0:e0])[-overlap:])
        while tail and tail[0] & 0xC0 == 0x80:
            tail = tail[1:]
        assert text[s:b].encode() == tail
    return pieces


def test_pieces_cover_fit_and_overlap():
    for text in TEXTS:
        check(text, 128, 16)
    pieces = check(TEXTS[0], 512, 48)
    assert {c for *_, c in pieces[1:]} <= {"heading", "block", "item", "line", "sentence", "word"}
    assert not any(TEXTS[0][b:].startswith("# no heading") for _, b, _, _, _ in pieces)
    assert S.split("", 10, 2) == [] and S.split("short", 10, 2) == [(0, 0, 5, 1, "")]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab .\n#-é漢<>`1", max_size=400))
def test_any_text(text):
    if text:
        check(text, 24, 4)


def test_tables(spark):
    df = spark.createDataFrame([(1, TEXTS[0], 9), (2, None, 9), (3, "", 9), (None, "x", 9), (4, "short", 9)], "doc_id long, text string, piece int")
    got = S.split_all(df, 128, 16).collect()
    assert {r["doc_id"] for r in got} == {1, 4} and S.split_all(df.limit(0), 128, 16).collect() == []
    n = {r["doc_id"]: r["n_tokens"] for r in T.counted(df, ["doc_id"], "text").collect()}
    assert n[2] == n[3] == 0 and n[4] == 1


def test_an_overlap_over_half_the_limit_is_refused():
    with pytest.raises(ValueError):
        S.split("some text", 10, 6)


def test_a_total_that_a_source_cannot_meet_is_reported(spark):
    sized = spark.createDataFrame([(i, "a" if i < 10 else "b", 10) for i in range(110)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, target_share double, max_repeat int")
    plan = M.plan(sized, targets, total=1000)
    got = {r["source"]: r for r in M.shares(M.mix(sized, plan), plan).collect()}
    assert got["a"]["tokens"] == 200 and got["a"]["most_copies"] == 2 and got["b"]["tokens"] == 500
