import hashlib
import re
from collections import Counter

from skein.plans import catalog

TEXTS = {
    "a": "x = 1\n\u00e9t\u00e9 = 2  \nreturn \u00e9t\u00e9\n",
    "b": "\u0130" * 30 + "\u4e2d" * 300 + " Return it\u0130 " + "\u00fc" * 300,
    "c": "x = 1\n",
    "d": "\u00e9" * 400,
}
ASKED = {"q1": "wo ist gr\u00f6\u00dfe", "q2": "how is \u00e9 made", "q3": "\u00a0kernel\t", "q4": None}
DOCS = {1: "one\nwith the \u00e9", 2: "kernel\n", 3: "\r\n", 4: None, 5: "first\nsrc/b.py"}
STOPS = "the a an with for and or when where how".split()


def kind(query):
    q = (query or "").strip()
    words = q.split()
    stops, last = sum(w.lower() in STOPS for w in words), q.split("/")[-1]
    path = bool(re.search(r"[/\\\\]|::", q)) or "." in last and last[0] != "." and bool(re.search("[A-Za-z]", last))
    name = bool(re.search(r"[_()<>#A-Z]|->", q)) or len(words) == 1 and bool(re.fullmatch("[A-Za-z0-9_:-]+", q))
    if not q:
        return "natural_language"
    if path:
        return "mixed" if len(words) > 1 and (name or stops) else "path"
    if name:
        return "mixed" if len(words) > 2 and stops else "identifier"
    return "natural_language" if stops and len(words) > 2 else "mixed" if len(words) > 1 else "identifier"


def snippet(text):
    low = "".join("i" if c == "\u0130" else c.lower() for c in text)
    at = next((low.index(w) for w in ("return", "broker") if w in low), None)
    if len(text) <= 220:
        return text
    if at is None:
        return text[:220] + "\n..."
    a, b = max(at - 73, 0), min(at + 146, len(text))
    return "..." * (a > 0) + text[a:b] + "..." * (b < len(text))


def test_rows_with_other_letters_are_kept(spark, tmp_path):
    chunks = [(k, "r", f"f{k}.py", v, 1, 3) for k, v in TEXTS.items()]
    spark.createDataFrame(chunks, "id string, repo string, relative_path string, content string, start_line long, end_line long").write.parquet(f"{tmp_path}/chunk_doc.parquet")
    spark.createDataFrame(list(ASKED.items()), "query_id string, query string").write.parquet(f"{tmp_path}/search_query.parquet")
    spark.createDataFrame(list(DOCS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {r[0]: r[1] for r in got("classify_queries")} == {k: kind(v) for k, v in ASKED.items()} | {f"d{k}": kind(v) for k, v in DOCS.items()}
    assert {r[0]: r[1] for r in got("snippets")} == {k: hashlib.md5(snippet(v).encode()).hexdigest() for k, v in TEXTS.items()}
    split = {k: [x.strip() for x in v.removesuffix("\n").split("\n")] for k, v in TEXTS.items()}
    want = {(f"f{k}.py", hashlib.md5(line.encode()).hexdigest()): n for k, ls in split.items() for line, n in Counter(x for x in ls if x).items()}
    assert {(r["relative_path"], r["line_md5"]): r["n"] for r in got("line_histogram")} == want
    best = {}
    for k, ls in split.items():
        scored = [(-(1000 * (ls.count(x) == 1) + 25 * bool(re.search(r"[=:()\[\]{}]", x)) + 100 - i + 500 * (i == 0) + 600 * ("return" in x)), i + 1, x) for i, x in enumerate(ls)]
        for s, n, x in sorted(scored)[:2]:
            best[k, n] = (x, -s)
    assert {(r["id"], r["line_no"]): (r["anchor"], r["score"]) for r in got("anchor_rank")} == best
    assert {r["id"]: r["state"] for r in got("window_ready")} == dict.fromkeys(TEXTS, "ready")
