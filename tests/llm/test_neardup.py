import random
from collections import Counter

import numpy as np
from pyarrow.dataset import dataset

from skein.llm import neardup as N
from skein.runtime import Stage


def similarity(a, b):
    x, y = Counter(N.WORD.findall(a.lower())), Counter(N.WORD.findall(b.lower()))
    low = sum(min(x[k], y[k]) for k in x)
    return low / (sum(x.values()) + sum(y.values()) - low)


def corpus():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    texts = {}
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        texts[f"b{i:02}"] = " ".join(base)
        for j in range(3):
            edited = list(base)
            for _ in range(rng.randrange(0, 14)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rng.shuffle(edited)
            texts[f"e{i:02}_{j}"] = "\n".join(edited).upper()
    texts["copy"] = texts["b00"]
    return texts


def test_pairs_equal_brute_force(spark):
    texts = corpus()
    rows = [(k, v, b"x") for k, v in texts.items()] + [("b00", texts["b00"], b"x"), ("null", None, b"x"), (None, texts["b01"], b"x"), ("empty", "", b"x"), ("short", "one two", b"x"), ("long", "lonely " * 20000, b"x")]
    df = spark.createDataFrame(rows, "id string, content string, cls binary")
    got = {(r[0], r[1]) for r in N.similar_pairs(*N.similar_classes(df, "id", "content")).collect()}
    ids = sorted(k for k, v in texts.items() if len(N.WORD.findall(v.lower())) >= 30)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(texts[a], texts[b]) >= 0.7}
    assert got == want and len(want) > 60


def test_large_groups_of_copies_give_stars_and_hot_bands_are_split(spark):
    texts = corpus()
    df = spark.createDataFrame([(f"c{i:03}", texts["b00"]) for i in range(90)] + [("near", texts["b00"] + " extra")], "id string, content string")
    members, links = N.similar_classes(df, "id", "content", block=1)
    got = {(r[0], r[1]) for r in N.similar_pairs(members, links).collect()}
    assert got == {("c000", f"c{i:03}") for i in range(1, 90)} | {("c000", "near")}
    assert members.count() == 91


def test_estimate_of_probability_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 2**63, 60).astype(np.uint64)
    b = np.concatenate([a[:45], rng.integers(1, 2**63, 15).astype(np.uint64)])
    sig = N.probminhash(np.repeat([0, 1], 60), np.concatenate([a, b]), np.ones(120), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 45 / 75) < 0.04
    w = np.concatenate([np.full(60, 1.0), np.full(60, 7.0)])  # the scale of a text's weights does not matter
    again = N.probminhash(np.repeat([0, 1], 60), np.concatenate([a, b]), w, 2, 4096)
    assert abs((again[0] == again[1]).mean() - 45 / 75) < 0.04


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert N.similar_pairs(*N.similar_classes(df, "id", "content")).collect() == []


def test_reordered_versions_in_a_large_class_give_every_pair(spark):
    rng = random.Random(3)
    base = [f"word{i}" for i in range(50)]
    texts = {f"r{i:03}": " ".join(rng.sample(base, 50)) for i in range(80)}
    texts["near"] = " ".join([*base, "extra"])
    rows = [*texts.items(), *((f"s{i:03}", texts["r000"]) for i in range(70))]
    members, links = N.similar_classes(spark.createDataFrame(rows, "id string, content string"), "id", "content")
    ids = sorted(k for k, _ in rows)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    assert {(r[0], r[1]) for r in N.similar_pairs(members, links, star_above=None, block=16).collect()} == want
    stars = {(r[0], r[1]) for r in N.similar_pairs(members, links).collect()}
    assert stars == {(a, b) for a, b in want if not b.startswith("s")} | {("r000", f"s{i:03}") for i in range(70)}


def test_hot_bands_compare_by_rare_elements_and_lose_no_pair(spark):
    """Half of each text is boilerplate that fills the bands; every similar pair is still found."""
    rng = random.Random(8)
    common = [f"shared{i}" for i in range(30)]
    texts = {}
    for i in range(60):
        own = [f"own{i}_{j}" for j in range(rng.randrange(6, 24))]
        for v in range(2):
            texts[f"t{i:02}_{v}"] = " ".join([*common, *own, *(["tail"] * v)])
    df = spark.createDataFrame([*texts.items()], "id string, content string")
    ids = sorted(texts)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(texts[a], texts[b]) >= 0.7}
    got = {(r[0], r[1]) for r in N.similar_pairs(*N.similar_classes(df, "id", "content", bands=60, rows=3, block=3, broadcast_rows=0)).collect()}
    assert got == want and 60 < len(want) < 2000


def test_crowded_bands_are_compared_in_place_and_leave_no_shuffle_files(spark, monkeypatch):
    """texts that share boilerplate and fall just short of the threshold: only pairs that reach it are written."""
    rng = random.Random(4)
    common, own = [f"shared{i}" for i in range(30)], [f"own{i}" for i in range(60)]
    texts = {f"t{i:03}": " ".join([*common, *rng.sample(own, 20)]) for i in range(100)}
    texts |= {f"e{i:03}": texts[f"t{i:03}"] + " tail" for i in range(0, 100, 10)}
    pairs, save = [], Stage.save

    def saved(self, df):
        table = save(self, df)
        if df.columns[0] in ("cls_1", "key_1"):
            pairs.append(dataset(table._skein_path.removeprefix("file://")).count_rows())
        return table

    monkeypatch.setattr(Stage, "save", saved)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getPath(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    members, links = N.similar_classes(spark.createDataFrame([*texts.items()], "id string, content string"), "id", "content", block=2, broadcast_rows=0)
    left = sum(size for path, size in files().items() if path not in before)
    names = {bytes(r.cls): r.id for r in members.collect()}
    got = {tuple(sorted((names[bytes(r.cls_1)], names[bytes(r.cls_2)]))): r.similarity for r in links.collect()}
    ids = sorted(texts)
    want = {(a, b): s for i, a in enumerate(ids) for b in ids[i + 1 :] if (s := similarity(texts[a], texts[b])) >= 0.7}
    assert got == want and len(want) >= 10
    assert max(pairs) < 5 * len(texts), pairs
    assert left < 50_000, left


def test_counts_of_common_elements():
    rng = np.random.default_rng(6)
    texts = [np.unique(np.concatenate([rng.integers(0, 9, 6), rng.integers(0, 2000, rng.integers(1, 90))])) for _ in range(90)]
    got = np.concatenate([c for _, c in N._common(texts[:40], texts[40:])])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in texts[40:]] for a in texts[:40]]
