import math
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import fusion, lines, retrieval, state, symbols


def test_bm25_against_brute_force(spark):
    docs = {"a": "alpha beta beta", "b": "beta gamma", "c": "", "d": "delta alpha alpha alpha"}
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [("n", None, "x")], "id string, body string, doc string")
    asked = spark.createDataFrame([("q", "alpha"), ("q", "beta"), ("q", "beta"), ("q", "nothing")], "query_id string, term string")
    got = {r["doc"]: r["score"] for r in retrieval.field_bm25(df.drop("doc"), "id", retrieval.one_field("body"), asked).collect()}
    words = {k: v.split() for k, v in docs.items() if v}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    for k, w in words.items():
        want = 0.0
        for t in ("alpha", "beta"):
            df_ = sum(t in x for x in words.values())
            tf = Counter(w)[t]
            want += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0
        assert abs(got.get(k, 0.0) - want) < 1e-9


def test_fusion_sums_sources_and_names_them(spark):
    a = spark.createDataFrame([("q", "x", 5.0), ("q", "y", 4.0)], "query_id string, id string, score double")
    b = spark.createDataFrame([("q", "x", 0.2)], "query_id string, id string, score double")
    got = {r["id"]: r for r in fusion.fuse([fusion.source(a, "dense", F.lit(2.0), ["query_id"]), fusion.source(b, "lexical", F.lit(0.0), ["query_id"])], ["query_id"]).collect()}
    assert abs(got["x"]["score"] - (2 / 101 + 0.35 * 2)) < 1e-9 and got["x"]["match_type"] == "dense"


def test_literal_matches(spark):
    df = spark.createDataFrame([("f", "alpha foo\nfoobar\nFoo\n"), ("n", None), ("e", "")], "id string, t string")
    whole = lines.literal_matches(df, ["id"], "t", "foo", case_sensitive=False, whole_word=True).collect()
    assert sorted(r["line_no"] for r in whole) == [1, 3]
    assert sum(r["n_matches"] for r in lines.literal_matches(df, ["id"], "t", "foo", case_sensitive=False).collect()) == 3
    assert lines.literal_matches(df, ["id"], "t", "").collect() == []
    assert lines.literal_matches(df, ["id"], "t", "a.b(").collect() == []


def test_narrowest_pick_window_and_readiness(spark):
    spans = spark.createDataFrame([("f", "outer", 10, 30), ("f", "inner", 18, 22)], "file string, sid string, start_line long, end_line long")
    places = spark.createDataFrame([("f", 20), ("f", 5)], "file string, line_no long")
    assert [(r["line_no"], r["sid"]) for r in lines.narrowest(places, spans, ["file"], "sid").collect()] == [(20, "inner")]
    m = spark.createDataFrame([("f", 10, 15), ("f", 20, 15), ("g", 10, 12), ("g", 20, 12)], "file string, line_no long, hint long")
    assert [(r["file"], r["line_no"]) for r in lines.pick(m, ["file"], "hint").collect()] == [("g", 10)]
    rows = [(t, a, b) for t in (0, 1, 3, 30, 100) for a in range(0, t + 3, 4) for b in range(a, min(a + 9, t + 3), 3)]
    df = spark.createDataFrame(rows, "t long, a long, b long")
    for before, after, most in ((8, 24, 96), (10, 10, 5), (0, 7, 4), (9, 2, 6)):
        got = [(r["t"], r["a"], r["b"], *r["w"]) for r in df.withColumn("w", lines.bounded_window(F.col("t"), F.col("a"), F.col("b"), before, after, most)).collect()]
        assert got == [(*r, *_window(*r, before, after, most)) for r in rows]
    states = spark.createDataFrame([(160, 1), (161, 1), (5, 0)], "n long, u long")
    assert [r[0] for r in states.select(lines.readiness(F.col("n"), F.col("u"))).collect()] == ["ready", "window_too_broad", "weak_anchors"]


def _window(total, first, last, before, after, most):
    """One line at a time, from the longer side."""
    if not total:
        return 0, 0, False
    first = min(max(first, 1), total)
    last = min(max(last, first), total)
    span = list(range(max(1, first - before), min(total, last + after) + 1))
    cut = len(span) > most
    while len(span) > most and (span[0] < first or span[-1] > last):
        span.pop(-1 if span[-1] - last > first - span[0] else 0)
    return span[0], span[-1], cut


def test_uniqueness_of_anchors_is_that_of_the_file(spark):
    text = "def a():\n    x = one()\n    y = 1\n\ndef b():\n    x = one()\n    z = 2\n"
    df = spark.createDataFrame([("f", text)], "file string, t string")
    rows = lines.numbered(df, ["file"], "t").withColumn("owner", F.when(F.col("line_no") <= 3, "a").when(F.col("line_no") >= 5, "b"))
    got = {(r["owner"], r["anchor"]): r["unique_in_file"] for r in lines.anchors(rows, ["owner"], 3, file=["file"]).collect()}
    assert got[("a", "x = one()")] is False and got[("b", "z = 2")] is True


def test_literal_over_a_line_end(spark):
    df = spark.createDataFrame([("é;\nx;\n;\n",)], "t string")
    assert [tuple(r) for r in lines.literal_spans(df, [], "t", ";\n").orderBy("start_byte").collect()] == [(2, 4, 1, 1), (5, 7, 2, 2), (7, 9, 3, 3)]


def test_anchor_is_unique_and_holds_the_query(spark):
    df = spark.createDataFrame([("f", "def build_value():\n    x = 1\n    x = 1\n    return build_value\n}")], "id string, t string")
    got = lines.anchors(lines.numbered(df, ["id"], "t"), ["id"], 1, "return").collect()
    assert got[0]["anchor"] == "return build_value" and got[0]["unique_in_file"]


def test_root_hash_is_one_ordered_fold(spark):
    df = spark.createDataFrame([("r", "b.rs", "222"), ("r", "a.rs", "111"), ("r", "a.rs", "111"), ("s", "x", None)], "repo string, relative_path string, file_hash string")
    want = {"r": xxhash.xxh3_128_hexdigest(b"a.rs:111\nb.rs:222\n"), "s": xxhash.xxh3_128_hexdigest(b"x:\n")}
    assert {r["repo"]: r["root_hash"] for r in state.root_hashes(df).collect()} == want
    assert state.root_hashes(df.limit(0)).collect() == []


def test_outline_order_orphans_and_budgets(spark):
    rows = [("r", "f", "p", "A", 1, 20, None), ("r", "f", "c2", "z", 5, 6, "p"), ("r", "f", "c1", "a", 5, 6, "p"), ("r", "f", "late", "b", 2, 3, "p"), ("r", "f", "orphan", "o", 4, 4, "gone"), ("r", "f", "below", "u", 4, 4, "orphan"), ("r", "g", "other", "x", 1, 1, "p")]
    df = spark.createDataFrame(rows, "repo string, relative_path string, symbol_id string, name string, start_line long, end_line long, parent_symbol_id string").withColumn("kind", F.lit("k"))
    got = [(r["relative_path"], r["symbol_id"], r["depth"], r["truncated"]) for r in symbols.outline(df, 12, 8, 1).orderBy("relative_path", "position").collect()]
    assert got == [("f", "p", 0, False), ("f", "late", 1, False), ("f", "c1", 1, False), ("f", "c2", 1, False)]
    assert [(r["symbol_id"], r["truncated"]) for r in symbols.outline(df, 2, 8, 1).orderBy("position").collect()] == [("p", True), ("late", True)]


def test_overlay_merge_and_hidden_files(spark):
    hits = spark.createDataFrame([("r", "changed", "1", 1.0), ("r", "unchanged", "2", 0.5)], "repo string, relative_path string, id string, score double")
    over = spark.createDataFrame([("r", "changed", "3", 3.0), ("r", "new", "4", 2.0)], hits.schema)
    overlay = spark.createDataFrame([("r", "changed", "completed"), ("r", "unchanged", "stale")], "repo string, relative_path string, overlay_status string")
    assert [r["relative_path"] for r in state.merged_top(hits, over, overlay, 3).orderBy("rank").collect()] == ["changed", "new", "unchanged"]
    states = spark.createDataFrame([("r", ["a", "b"], ["b", "c"]), ("s", None, None)], "repo string, replaced_paths array<string>, deleted_paths array<string>")
    assert {r["relative_path"] for r in state.hidden_files(states).collect()} == {"a", "b", "c"}


def test_changes_and_carry_forward(spark):
    old = spark.createDataFrame([("r", "a.rs", "1"), ("r", "b.rs", "2"), ("r", "d.rs", None)], "repo string, relative_path string, file_hash string")
    new = spark.createDataFrame([("r", "a.rs", "1"), ("r", "b.rs", "3"), ("r", "c.rs", "4")], "repo string, relative_path string, file_hash string")
    ch = state.changes(old, new)
    assert {(r["relative_path"], r["change"]) for r in ch.collect()} == {("a.rs", "unchanged"), ("b.rs", "modified"), ("c.rs", "added"), ("d.rs", "removed")}
    kept = state.carried_forward(old, ch, new.where("relative_path in ('b.rs', 'c.rs')"))
    assert {(r["relative_path"], r["file_hash"]) for r in kept.collect()} == {("a.rs", "1"), ("b.rs", "3"), ("c.rs", "4")}


def test_overlay_and_requests(spark):
    hits = spark.createDataFrame([("r", "changed", "1"), ("r", "unchanged", "2")], "repo string, relative_path string, id string")
    mine = spark.createDataFrame([("r", "changed", "o1"), ("r", "new", "o2")], "repo string, relative_path string, id string")
    overlay = spark.createDataFrame([("r", "changed", None)], "repo string, relative_path string, overlay_status string")
    assert {r["id"] for r in state.merged(hits, mine, overlay).collect()} == {"o1", "o2", "2"}
    requests = spark.sql("select 'r' repo, true force, false explicit, timestamp'2026-01-01' at union all select 'r', false, false, timestamp'2026-01-02'")
    row = state.merge_requests(requests).first()
    assert row["force"] and not row["explicit"] and row["n"] == 2


def test_budget_status_and_staleness(spark):
    files = spark.createDataFrame([("r", "a", 5), ("r", "b", 6), ("r", "c", 1)], "repo string, relative_path string, chunks long")
    assert [r["relative_path"] for r in state.within_budget(files, 10).collect()] == ["a"]
    s = spark.createDataFrame([(0, 0), (1, 10), (1, 3)], "f long, c long").select(state.index_status(F.col("f"), F.col("c"), 10))
    assert [r[0] for r in s.collect()] == ["empty", "limit_reached", "completed"]


def test_outline_and_chunk_of_symbol(spark):
    rows = spark.createDataFrame(
        [("r", "m", "f", "mod", "module", None, 1, 9, None), ("r", "s", "f", "S", "struct", "mod", 2, 3, "m"), ("r", "x", "f", "X", "struct", None, 30, 31, "gone"), ("r", "k", "g", "K", "class", None, 1, 2, None)],
        "repo string, symbol_id string, relative_path string, name string, kind string, container string, start_line long, end_line long, parent_symbol_id string",
    )
    got = [(r["relative_path"], r["position"], r["name"], r["depth"]) for r in symbols.outline(rows).orderBy("relative_path", "position").collect()]
    assert got == [("f", 1, "mod", 0), ("f", 2, "S", 1), ("g", 1, "K", 0)]
    chunks = spark.createDataFrame([("r", "f", "c1", 1, 5), ("r", "f", "c2", 6, 20)], "repo string, relative_path string, id string, start_line long, end_line long")
    held = {r["symbol_id"]: (r["chunk_id"], r["covers"]) for r in symbols.chunk_of_symbol(rows, chunks).collect()}
    assert held == {"m": ("c1", True), "s": ("c1", True), "x": ("c2", False), "k": ("symbol:k", False)}
    assert T.LANGUAGES[".h"] == "c"
