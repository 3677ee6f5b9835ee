import numpy as np

from skein.llm import ranking as R


def frame(spark, rows):
    return spark.createDataFrame(rows, "q string, i string, s double")


def values(df):
    return {(r["group"], r["item"]): r["value"] for r in df.collect()}


def test_rank_transform_nulls_ties_repeats_and_nan(spark):
    df = frame(spark, [("q", "a", 5.0), ("q", "a", 5.0), ("q", "b", -1e9), ("q", "c", 1e12), ("q", "d", None), ("q", "e", float("nan")), (None, "a", 1.0), ("t", "x", 1.0), ("t", "y", 1.0)])
    assert values(R.rank_transform(df, "q", "i", "s")) == {("q", "b"): 1 / 3, ("q", "a"): 2 / 3, ("q", "c"): 1.0, ("t", "x"): 0.75, ("t", "y"): 0.75}
    assert values(R.rank_transform(df.where("q = 'q'"), "q", "i", "s", higher=False))[("q", "c")] == 1 / 3


def test_both_lists_count_equally_whatever_their_scale(spark):
    a = frame(spark, [("q", x, s) for x, s in [("both", 4000.0), ("huge", 1e15), ("low", 1.0), ("mid", 2.0)]])
    b = frame(spark, [("q", x, s) for x, s in [("both", 0.9), ("other", 0.8), ("low", 0.1)]])
    fused = R.fuse([R.rank_transform(x, "q", "i", "s") for x in (a, b)])
    limits = spark.createDataFrame([("q", 2), ("q", 2), ("none", 3), ("z", None)], "group string, top_n int")
    top = R.top_items(fused, limits).orderBy("position").collect()
    assert [r["item"] for r in top][0] == "both" and len(top) == 2


def test_loadings_follow_declared_directions(spark):
    rng = np.random.default_rng(1)
    x = rng.random(200)
    rows = [(float(v), float(1 - v + rng.random() / 10), float(v + rng.random() / 10)) for v in x]
    wide = spark.createDataFrame(rows, "a double, b double, c double")
    w = R.loadings(wide, ["a", "b", "c"], [1, -1, 1])
    m = np.corrcoef(np.array(rows).T)
    v = np.linalg.eigh(m)[1][:, -1]
    assert np.allclose(np.abs(w), np.abs(v)) and (np.sign(w) == [1, -1, 1]).all()
    assert np.allclose(R.loadings(wide, ["a", "b"]), [2**-0.5, 2**-0.5])


def test_empty(spark):
    e = frame(spark, [])
    assert R.fuse([R.rank_transform(e, "q", "i", "s")] * 2).collect() == []


def test_a_list_that_runs_against_the_others_is_named(spark):
    df = spark.createDataFrame([(float(i), float(i) * 2, float(-i)) for i in range(20)], "a double, b double, c double")
    assert R.disagreeing(df, ["a", "b", "c"]) == ["c"] and R.disagreeing(df, ["a", "b", "c"], [1, 1, -1]) == []


def test_a_list_without_variation_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "a double, b double")
    assert np.allclose(np.abs(R.loadings(df, ["a", "b"])), 2**-0.5)
