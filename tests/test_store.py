import subprocess

import pytest

from skein.sources import config
from skein.sources.store import Store


def test_store_versions_upsert_delete_clear(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "c", 3)], "repo string, relative_path string, n int")
    s.write("chunks", df)
    s.upsert("chunks", spark.createDataFrame([("r1", "a", 9)], df.schema).select("repo", "relative_path", "n"), ["repo", "relative_path"])
    assert {(r["relative_path"], r["n"]) for r in s.read("chunks").collect()} == {("a", 9), ("b", 2), ("c", 3)}
    s.delete("chunks", spark.createDataFrame([("r1", "b")], "repo string, relative_path string"), ["repo", "relative_path"])
    assert s.read("chunks").count() == 2 and s.tables() == ["chunks"]
    assert s.clear(["r1"]) == {} and [r["n"] for r in s.read("chunks").collect()] == [3]
    assert not s.compact("chunks") and s.compact("chunks", deleted=300, rows=400)
    s.drop("chunks")
    assert not s.exists("chunks")


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('default_group = "g"\n[[groups]]\nid = "g"\nrepos = ["a", "./b/../a", "/x"]\n[overlay]\nmax_bytes = "2kb"\n[search]\nmax_warm_repos = 7\n')
    c = config.load(str(f))
    assert c.scope() == [str(tmp_path / "a"), "/x"] and c.overlay_bytes == 2048 and c.search["max_warm_repos"] == 7 and c.repos() == sorted(c.scope())
    f.write_text('[search]\nmax_warm_repos = 0\n')
    with pytest.raises(ValueError):
        config.load(str(f))
    with pytest.raises(ValueError):
        c.scope("none")
    with pytest.raises(ValueError):
        config.byte_size("many")


def test_working_copy(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    f = config.fingerprint(str(tmp_path))
    assert f["last_root_mtime"] and f["last_head"] is None
    assert config.inside(str(tmp_path), "a/b") and not config.inside(str(tmp_path), "../x")
    assert len(config.overlay_id("a", "b")) == 16
