from skein.api import Index

CHUNK = "id string, repo string, relative_path string, basename string, extension string, language string, content string, start_line long, end_line long, indexed_at string, file_hash string"
SYMBOL = "symbol_id string, repo string, relative_path string, name string, kind string, container string, language string, start_line long, end_line long, indexed_at string, file_hash string, parent_symbol_id string"
VECTOR = "id string, content string, relative_path string, file_extension string, metadata string, vector array<float>, start_line long, end_line long"


def index(spark, root):
    chunks, symbols, vectors = [], [], []
    for i in range(70):
        chunks.append((f"hot{i:02}", "hot", f"src/h{i}.py", f"h{i}.py", ".py", "python", "nothing", 1, 9, "t", "x"))
        symbols.append((f"s{i:02}", "hot", f"src/h{i}.py", "alpha", "function", None, "python", 1, 9, "t", "x", None))
        vectors.append((f"hot{i:02}", "", "", ".py", None, [1.0, 0.0], 1, 9))
    for repo, path in (("hot", "deep/a.go"), ("cold", "src/b.py")):
        chunks.append((f"{repo}-far", repo, path, path.split("/")[1], "." + path.split(".")[1], "x", "nothing", 1, 9, "t", "x"))
        symbols.append(("far", repo, path, "alpha_helper alpha with many other words", "function", None, "x", 2, 9, "t", "x", None))
        vectors.append((f"{repo}-far", "", "", "", None, [1.0, 0.1], 1, 9))
    for name, rows, schema in (("chunk_doc", chunks, CHUNK), ("symbol_row", symbols, SYMBOL), ("vector_doc", vectors, VECTOR), ("file_state", [], "repo string, relative_path string, file_hash string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return Index(spark, str(root))


def test_filters_and_hot_repositories_hide_no_candidates(spark, tmp_path):
    i = index(spark, tmp_path)
    for narrow in ({"prefix": "deep"}, {"file": "deep/a.go"}, {"extensions": [".go"]}, {"language": "x", "repos": ["hot"]}):
        assert [(r["id"], r["match_type"]) for r in i.search_code("alpha", **narrow).collect()] == [("hot-far", "symbol")]
    every = {r["id"] for r in i.search_code("alpha", limit=50).collect()}
    assert "cold-far" in every
    near = i.search_code("zebra", limit=50, mode="semantic", vector=[1.0, 0.0]).collect()
    assert ("cold-far", "dense") in {(r["id"], r["match_type"]) for r in near}
