import pytest
from pyspark.sql import functions as F

from skein import api, ingest
from skein.functions import embed, shapes
from skein.sources.store import Store
from skein.streaming import jobs

PYTHON = "import os\n\n\nclass UserIndex:\n    def build_index(self, rows):\n        total = len(rows)\n        return total\n\n    def clear_index(self):\n        return None\n\n\ndef load_users(path):\n    return UserIndex().build_index([path])\n"
RUST = "mod graph {\n    struct Schema {\n        name: String,\n    }\n\n    impl Schema {\n        fn build(&self) -> usize {\n            self.name.len()\n        }\n    }\n}\n"


def make(tmp_path, name="repo"):
    root = tmp_path / name
    (root / "src").mkdir(parents=True)
    (root / "src/users.py").write_text(PYTHON)
    (root / "src/graph.rs").write_text(RUST)
    (root / "notes.md").write_text("# Users\n\nThe user index is built by load_users.\n\n# More\n\ntext\n")
    return root


def test_a_repository_is_indexed_searched_changed_and_cleared(spark, tmp_path):
    root, store, e = make(tmp_path), Store(spark, str(tmp_path / "index")), embed.HashingEmbedder(16)
    done = ingest.refresh(store, str(root), e)
    assert (done["added"], done["files"], done["status"]) == (3, 3, "completed")
    i = api.Index(spark, store)
    top = i.search_code("UserIndex", limit=3).collect()
    assert top[0]["relative_path"] == "src/users.py" and not top[0]["stale"] and top[0]["indexed_at"]
    assert i.search_code("user index built", mode="semantic", vector=e.embed(["the user index is built by load_users."])[0]).count() == 3
    assert i.search_code("build_index", context=True).first()["snippet"]
    assert i.search_symbols("build_index").first()["name"] == "build_index"
    assert i.search_symbols("build index", vector=e.embed(["method build_index in UserIndex from src/users.py (python)"])[0]).first()["name"] in ("build_index", "UserIndex")
    assert [r["line_no"] for r in i.search_text("def build_index", file="src/users.py").collect()] == [5]
    outline = i.get_file_outline("src/users.py", depth=2).orderBy("position").collect()
    assert [(r["name"], r["depth"]) for r in outline] == [("UserIndex", 0), ("build_index", 1), ("clear_index", 1), ("load_users", 0)]
    target = i.prepare_edit_target(str(root), "src/users.py", line_hint=6).first()
    assert (target["name"], target["start_line"], target["status"]) == ("build_index", 5, "ready")
    sid = i.search_symbols("load_users").first()["symbol_id"]
    assert i.prepare_edit_target(str(root), symbol_id=sid).first()["name"] == "load_users" and i.symbol(sid).count() == 1
    assert i.prepare_edit_target(str(root), "src/users.py", query="total = len").first()["name"] == "build_index"
    assert i.prepare_edit_target(str(root), "src/users.py", query="return").collect() == []
    assert i.prepare_edit_target(str(root), "src/users.py", query="return", occurrence=3).first()["name"] == "load_users"
    window = i.prepare_edit_target(str(root), "src/users.py", query="import os", max_lines=3).first()
    assert (window["kind"], window["start_line"], window["end_line"]) == ("window", 1, 3)
    assert [r["start_line"] for r in i.chunks_for_file(str(root), "src/users.py").collect()] == [4, 5, 9, 13]
    assert i.get_indexing_status().first()["status"] == "indexed" and i.list_scopes().count() == 1
    (root / "src/users.py").write_text(PYTHON.replace("load_users", "read_users"))
    (root / "notes.md").unlink()
    done = ingest.refresh(store, str(root), e)
    assert (done["modified"], done["removed"], done["unchanged"], done["files"]) == (1, 1, 1, 2)
    assert i.search_symbols("load_users").collect() == [] or i.search_symbols("load_users").first()["name"] != "load_users"
    assert store.read("vector_doc").select("relative_path").distinct().count() == 2 and store.read("symbol_vector").where("relative_path = 'notes.md'").count() == 0
    assert ingest.refresh(store, str(root), e)["unchanged"] == 2
    assert ingest.refresh(store, str(root), embed.HashingEmbedder(8))["added"] == 2  # another embedder: all anew
    assert len(store.read("vector_doc").first()["vector"]) == 8
    i.clear_index([str(root)])
    assert all(store.read(t).count() == 0 for t in ("chunk_doc", "symbol_row", "vector_doc", "symbol_vector", "file_state"))


def test_a_working_copy_takes_the_place_of_what_it_changed(spark, tmp_path):
    root, copy = make(tmp_path), make(tmp_path, "copy")
    store = Store(spark, str(tmp_path / "index"))
    ingest.refresh(store, str(root))
    (copy / "src/users.py").write_text(PYTHON.replace("UserIndex", "MemberIndex"))
    (copy / "src/graph.rs").unlink()
    (copy / "src/new.py").write_text("def added_here():\n    return 1\n")
    got = ingest.refresh_overlay(store, str(root), str(copy))
    assert got["status"] == "completed" and sorted(got["replaced"]) == ["src/new.py", "src/users.py"] and got["deleted"] == ["src/graph.rs"]
    i = api.Index(spark, store, overlay=got["overlay_id"])
    assert i.search_code("MemberIndex").first()["relative_path"] == "src/users.py" and i.search_code("added_here").count() == 1
    assert not [r for r in i.search_code("graph").collect() if r["relative_path"] == "src/graph.rs"]
    assert api.Index(spark, store).search_code("added_here").collect() == []
    ingest.make_overlays_stale(store, str(root))
    assert i.search_code("added_here").collect() == [] and i.search_code("UserIndex").count() > 0
    assert ingest.refresh_overlay(store, str(root), str(copy), files_at_most=1)["status"] == "too_large"
    assert i.search_code("added_here").collect() == [] and not [r for r in i.search_code("UserIndex").collect() if r["relative_path"] == "src/users.py"]


def test_scopes_report_failures_and_answers_are_compact(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    a, b = make(tmp_path, "a"), make(tmp_path, "b")
    ingest.refresh(store, str(a))
    ingest.refresh(store, str(b))
    i = api.Index(spark, store)
    found = i.search_scope("UserIndex", [str(a), str(b)], limit=4)
    assert not found.partial and {r["repo"] for r in shapes.compact_hits(found.hits, []).collect()} == {str(a), str(b)}
    one = shapes.compact_hits(i.search_code("UserIndex", repos=[str(a)]), [])
    assert {r["repo"] for r in one.collect()} == {None} and "lexical_score" not in one.columns
    assert "lexical_score" in shapes.compact_hits(found.hits, [], diagnostics=True).columns
    text = [r[0] for r in shapes.hit_lines(one).collect()]
    assert all(x.split(":")[0].endswith((".py", ".rs", ".md")) for x in text)
    bad = i.search_scope("UserIndex", [str(a), str(b)], vectors={"default": [1.0]}, mode="semantic")
    assert set(bad.errors) == {str(a), str(b)} and bad.hits is None
    assert shapes.summary(2, "hit", {"x": "gone"}) == "2 hits found. 1 repositories failed: x: gone."


def test_vectors_are_inserted_and_deleted(spark):
    v = spark.createDataFrame([("a", "x", "p", "{}", [1.0])], "id string, content string, relative_path string, metadata string, vector array<float>")
    rows = spark.createDataFrame([("b", "y", "q", "r")], "id string, content string, relative_path string, repo string")
    more = api.insert_vectors(v, rows, ["repo"], embed.HashingEmbedder(4))
    assert {r["id"]: len(r["vector"]) for r in more.collect()} == {"a": 1, "b": 4}
    assert [r["id"] for r in api.delete_vectors(more, api.vector_ids_of_path(more, "p")).collect()] == ["b"]
    assert api.delete_vectors(more, more.limit(0)).count() == 2


@pytest.mark.parametrize("state,event,want", [("idle", "request", "pending"), ("pending", "start", "running"), ("running", "request", "running"), ("running", "done", "idle"), ("running", "silent", "recovering"), ("recovering", "request", "recovering"), ("recovering", "recovered", "pending"), ("pending", "done", "pending")])
def test_states_of_a_job(spark, state, event, want):
    assert spark.range(1).select(jobs.after(F.lit(state), F.lit(event))).first()[0] == want


def test_progress_and_queue_states(spark):
    rows = [("r", 0.0, 0.2), ("r", 0.5, 0.9), ("r", 1.0, 1.1), ("r", 2.9, 1.2), ("r", 3.1, 1.3), ("s", 0.0, 5.0)]
    df = spark.createDataFrame(rows, "run string, at double, percent double")
    assert sorted((r["run"], r["at"]) for r in jobs.stored_progress(df, "run", ["at"], "percent").collect()) == [("r", 0.0), ("r", 1.0), ("r", 3.1), ("s", 0.0)]
    states = spark.createDataFrame([("a", "indexed", None, None), ("b", "indexed", None, None)], "repo string, status string, index_status string, error_message string")
    got = {r["repo"]: (r["status"], r["index_status"], r["error_message"]) for r in jobs.queue_states(states, states.where("repo = 'a'").select("repo"), spark.createDataFrame([("b", "no folder")], "repo string, message string")).collect()}
    assert got == {"a": ("indexed", "queued", None), "b": ("indexfailed", "failed", "no folder")}
    assert [r[0] for r in jobs.removed(states, states.where("repo = 'a'")).collect()] == ["b"]
