import time

import pytest

from skein import ingest
from skein.api import Index, clamp
from skein.plans import catalog
from skein.sources import scan
from skein.streaming import refresh


def test_scan_chunk_and_reindex(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("class A:\n    def f(self):\n        return 1\n\n\ndef g():\n    return 2\n")
    (root / "src/b.md").write_text("# T\n\ntext\n")
    (root / "src/bin.py").write_bytes(b"x\x00y")
    (root / "src/bad.py").write_bytes(b"\xff\xfe")
    (root / "src/lfs.py").write_text("version https://git-lfs.github.com/spec/v1\n")
    (root / "src/skip.py").write_text("x = 1\n")
    (root / ".hidden").mkdir()
    (root / ".hidden/h.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("# comment\nskip.py\n")
    (root / "note.txt").write_text("no\n")
    got = {r["relative_path"] for r in scan.scan(spark, str(root)).collect()}
    assert got == {"src/a.py", "src/b.md"}
    first = ingest.index_repo(spark, str(root))
    assert {(r["name"], r["kind"], r["container"]) for r in first["symbol_row"].collect()} == {("A", "class", None), ("f", "method", "A"), ("g", "function", None)}
    assert {r["name"]: r["parent_symbol_id"] is None for r in first["symbol_row"].collect()} == {"A": True, "f": False, "g": True}
    files = spark.createDataFrame(first["file_state"].collect(), first["file_state"].schema)
    (root / "src/a.py").write_text("def h():\n    return 3\n")
    (root / "src/b.md").unlink()
    second = ingest.index_repo(spark, str(root), files)
    assert {(r["relative_path"], r["change"]) for r in second["changes"].collect()} == {("src/a.py", "modified"), ("src/b.md", "removed")}
    assert {r["relative_path"] for r in second["chunk_doc"].collect()} == {"src/a.py"}


def test_nested_ignore_files_negation_links_and_added_extensions(spark, tmp_path):
    for name in ("keep.py", "gen/a.py", "gen/keep.py", "web/x.py", "web/lib/x.py", "other.py", "a.foo", "logs/x.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("gen/*\n!gen/keep.py\n")
    (tmp_path / "web/.gitignore").write_text("x.py\n!lib/x.py\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "keep.py")
    got = lambda **k: {r["relative_path"] for r in scan.scan(spark, str(tmp_path), **k).collect()}
    assert got(ignore=["logs"]) == {"keep.py", "gen/keep.py", "web/lib/x.py", "other.py"}
    assert "a.foo" in got(extensions=["foo"]) and "keep.py" in got(extensions=["foo"])
    assert got(below="web") == {"web/lib/x.py"} and got(below="gen/keep.py") == {"gen/keep.py"}
    assert [r[0] for r in scan.candidate_paths(spark, str(tmp_path), "gen").collect()] == ["gen/keep.py"]
    assert scan.snapshot(spark, str(tmp_path), "keep.py").first()["lines"] == 1
    for bad in ("../x.py", "none.py"):
        with pytest.raises((ValueError, FileNotFoundError)):
            scan.snapshot(spark, str(tmp_path), bad)


def test_minified_and_packing():
    assert scan.is_minified("x" * 4001) and not scan.is_minified("x\n" * 50)
    text = "\n".join(f"line {i}" for i in range(500))
    parts = scan.pack_lines(text, 100)
    assert "\n".join(c for c, _, _ in parts) == text and all(len(c) <= 100 for c, _, _ in parts)


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for i in range(3):
        spark.sql(f"select 'r{i % 2}' repo, {i == 0} force, false explicit, timestamp'2026-01-0{i + 1}' at, array('.x{i}') custom_extensions, cast(array() as array<string>) ignore_patterns").coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    q = refresh.run_queue(refresh.pending(spark, src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out/v=2")).collect()
    assert {(r["repo"], r["force"], r["n"], *r["custom_extensions"]) for r in last} == {("r0", True, 2, ".x2"), ("r1", False, 1, ".x1")}
    assert not (tmp_path / "out/v=0").exists()


def test_api(spark):
    index = Index(spark, "/root/testdata/sf0.001")
    hits = index.search_code("where is the kernel handle", limit=3).collect()
    assert 0 < len(hits) <= 3 and [h["score"] for h in hits] == sorted((h["score"] for h in hits), reverse=True)
    repo = hits[0]["repo"]
    assert index.search_text("return", repos=[repo]).count() <= 10
    assert clamp("limit", 500) == 50
    assert index.get_indexing_status().count() == 1
    sym = index.search_symbols("kernel", 2).collect()
    assert len(sym) <= 2
    if sym:
        index.prepare_edit_target(sym[0]["repo"], sym[0]["relative_path"], symbol_name=sym[0]["name"]).collect()
        index.get_file_outline(sym[0]["relative_path"]).collect()


def test_every_registered_query_has_a_plan_and_sql(spark):
    q, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(q)
    for name, f in q.items():
        if not name.startswith("p1_") and name != "outline_tree":
            assert f(spark, "/root/testdata/sf0.001").columns
