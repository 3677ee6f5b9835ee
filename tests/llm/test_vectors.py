import numpy as np

from skein.llm import vectors as V


def data(n=1500, groups=250, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, 64)) * 0.25).astype(np.float32)


def brute(ids, x, k=5, least=0.8):
    u = V.unit(x)
    s = np.round(u @ u.T, 10)
    np.fill_diagonal(s, -2)
    out = {}
    for i, name in enumerate(ids):
        h = np.flatnonzero(s[i] >= least)
        out[name] = [ids[j] for j in h[np.lexsort((np.array(ids)[h], -s[i][h]))][:k]]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "id string, vector array<float>, cls string")
    got = {}
    for r in V.neighbours(df, "id", "vector", **options).orderBy("id", "similarity").collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    return got


def test_factor_one_is_exact_and_the_default_nearly(spark):
    x = data()
    ids = [f"v{i:05}" for i in range(len(x))]
    rows = [(i, v.tolist(), "c") for i, v in zip(ids, x)]
    want = {k: set(v) for k, v in brute(ids, x).items() if v}
    assert run(spark, rows, slack=1.0, shard_rows=100, query_rows=300) == want
    few = V.MOST_SHARDS
    V.MOST_SHARDS = 2  # shards too large are searched in parts
    try:
        assert run(spark, rows, slack=1.0, shard_rows=30, query_rows=300) == want
    finally:
        V.MOST_SHARDS = few
    got = run(spark, rows)
    hit = sum(len(got.get(k, set()) & v) for k, v in want.items())
    assert hit / sum(map(len, want.values())) >= 0.95


def test_invalid_rows_copies_and_ties(spark):
    x = data(30, 30)
    rows = [(f"v{i:02}", v.tolist(), "c") for i, v in enumerate(x)]
    same = x[0].tolist()
    rows += [(f"c{i}", same, "c") for i in range(9)] + [("c0", same, "c"), ("scaled", (x[0] * 3).tolist(), "c")]
    rows += [("null", None, "c"), ("short", [1.0], "c"), ("zero", [0.0] * 64, "c"), ("nan", [float("nan")] * 64, "c"), ("hole", [None] + same[1:], "c"), (None, same, "c")]
    got = run(spark, rows, slack=1.0)
    assert got["c8"] == {"c0", "c1", "c2", "c3", "c4"} and got["c0"] == {"c1", "c2", "c3", "c4", "c5"} and got["v00"] == {"c0", "c1", "c2", "c3", "c4"}
    assert not {"null", "short", "zero", "nan", "hole"} & set(got)
    assert run(spark, []) == {}
