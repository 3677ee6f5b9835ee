import json
import os
import subprocess

import pytest

from skein.operators import filters, state
from skein.sources import copies, providers


def git(path, *args):
    subprocess.run(["git", "-C", str(path), "-c", "user.name=x", "-c", "user.email=x@x.test", *args], check=True, capture_output=True)


def test_another_checkout_of_a_repository_is_its_overlay(tmp_path):
    main, other, alone = tmp_path / "main", tmp_path / "other", tmp_path / "alone"
    for p in (main, alone):
        p.mkdir()
    git(main, "init", "-q")
    git(main, "commit", "-q", "--allow-empty", "-m", "x")
    git(main, "worktree", "add", "-q", str(other))
    assert copies.identity(str(main)).main and not copies.identity(str(other)).main and copies.identity(str(alone)) is None
    assert copies.context(str(main), [str(main)]) == copies.Context(str(main))
    got = copies.context(str(other), [str(main)])
    assert (got.repo, got.copy) == (str(main), str(other)) and got.overlay
    assert copies.context(str(other), [str(main)], overlays=False) == copies.Context(str(other))
    assert copies.context(str(alone), [str(main)]) == copies.Context(str(alone))
    with pytest.raises(ValueError):
        copies.main_checkouts([str(other)])


def test_repository_hints():
    repos = ["/a/one", "/b/two", "/c/two"]
    assert copies.pick(repos, "one") == "/a/one" and copies.pick(repos, " /c/two ") == "/c/two" and copies.pick(repos, None) is None
    assert copies.pick(["/a"], None, one=True) == "/a"
    for hint, one in (("two", False), ("three", False), (None, True)):
        with pytest.raises(ValueError):
            copies.pick(repos, hint, one)


def test_retries_give_up_on_errors_that_will_not_pass():
    waits, answers = [], [(503, b""), OSError("cut"), (200, b"ok")]

    def send():
        a = answers.pop(0)
        if isinstance(a, OSError):
            raise a
        return a

    assert providers.with_retries(send, waits.append) == b"ok" and len(waits) == 2 and waits[1] > waits[0]
    for always in ((400, b"bad"), (503, b"full")):
        with pytest.raises(RuntimeError):
            providers.with_retries(lambda a=always: a, lambda s: None)


def test_keys_come_from_the_environment_or_a_private_file(tmp_path, monkeypatch):
    f = tmp_path / "key"
    f.write_text(" k1 \n")
    os.chmod(f, 0o600)
    assert providers.api_key("SKEIN_TEST_KEY", str(f)) == "k1"
    monkeypatch.setenv("SKEIN_TEST_KEY", "k2")
    assert providers.api_key("SKEIN_TEST_KEY", str(f)) == "k2"
    os.chmod(f, 0o644)
    (tmp_path / "link").symlink_to(f)
    for variable, file in ((None, str(f)), (None, str(tmp_path / "link")), (None, None), ("SKEIN_NO_KEY", None)):
        with pytest.raises(ValueError):
            providers.api_key(variable, file)


def test_what_is_sent_to_services_and_read_from_them():
    sent = []

    def send(address, headers, body, seconds):
        body = json.loads(body)
        sent.append((address, headers.get("Authorization"), body))
        vectors = [[float(len(t)), 0.0] for t in body["input"]]
        rows = [{"index": i, "embedding": v} for i, v in enumerate(vectors)][::-1]
        return 200, json.dumps({"embeddings": vectors} if address.endswith("/api/embed") else {"data": rows}).encode()

    texts = ["a" * (i + 1) for i in range(130)]
    for service, address in (("voyage", "https://api.voyageai.com/v1/embeddings"), ("openai", "https://api.openai.com/v1/embeddings"), ("ollama", "http://127.0.0.1:11434/api/embed")):
        sent.clear()
        e = providers.HttpEmbedder(service, "m", "k", send=send)
        assert [v[0] for v in e.embed(texts)] == [float(i + 1) for i in range(130)] and sent[0][:2] == (address, "Bearer k")
        assert len(sent) == (2 if service == "voyage" else 1) and ("input_type" in sent[0][2]) == (service == "voyage")
        assert e.dimension == 2
    assert providers.HttpEmbedder("openai", "text-embedding-3-small").dimension == 1536


def test_maintenance_arguments_and_names(spark):
    assert state.maintenance(False, 0) == (False, False) and state.maintenance(False, 1) == (True, False) and state.maintenance(False, 32) == (True, True) and state.maintenance(True, 0) == (True, True)
    assert filters.argument(" a\\b/ ", path=True) == "a/b" and filters.argument("  ") is None and filters.argument("Rust", lower=True) == "rust"
    df = spark.createDataFrame([("hybrid_symbols_x",), ("mine",)], "name string")
    assert [r[0] for r in df.where(filters.managed(df["name"])).collect()] == ["hybrid_symbols_x"]
    paths = spark.createDataFrame([("a.rs",), ("b.py",), ("c.txt",)], "p string")
    assert [r[0] for r in paths.where(filters.live(paths["p"], [".rs", ".py"], language="rust")).collect()] == ["a.rs"]
    chunks = spark.createDataFrame([("hybrid_code_chunks_a",), ("hybrid_code_chunks_b",), ("other",)], "name string")
    report = state.hygiene(chunks, chunks.where("name = 'hybrid_code_chunks_a'"), warm=4)
    assert {r["name"] for r in report[0].collect()} == {"hybrid_code_chunks_b"} and report[1] == 8
