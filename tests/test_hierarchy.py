import random

from skein.operators import hierarchy as H


def solve(rows):
    """Brute force: follow the parents."""
    parent = {(s, n): (s, p) for s, n, p in rows}
    out = {}
    for key in parent:
        seen, path, at = {key}, [key[1]], key
        while True:
            up = parent[at]
            if up not in parent:
                out[key] = (at[1], len(path) - 1, path[::-1])
                break
            if up in seen:
                out[key] = ("", -1, [])
                break
            seen.add(up)
            path.append(up[1])
            at = up
    return out


def check(spark, rows):
    links = spark.createDataFrame(rows, "scope string, node string, parent string")
    got = {(r["scope"], r["node"]): (r["root"], r["depth"], list(r["path"])) for r in H.resolve_forest(links, with_path=True).collect()}
    want = solve(rows)
    assert got == want
    below = {k: 0 for k in want}
    for (scope, _), (_, _, path) in want.items():
        for node in path:
            below[scope, node] += 1
    assert {(r["scope"], r["node"]): (r["root"], r["depth"], r["size"]) for r in H.resolve_forest(links, with_size=True).collect()} == {k: (*want[k][:2], below[k]) for k in want}


def test_forest_with_deep_chain_star_circles_and_two_scopes(spark):
    rows = [("a", f"c{i}", f"c{i - 1}" if i else None) for i in range(150)]
    rows += [("a", f"s{i}", "c149") for i in range(40)]
    rows += [("a", f"o{i}", f"o{(i + 1) % 7}") for i in range(7)] + [("a", "self", "self"), ("a", "hang", "o3"), ("a", "hang2", "hang")]
    rows += [("b", "c5", ""), ("b", "c6", "nowhere"), ("b", "x", "c5")]
    check(spark, rows)


def test_random_forests(spark):
    rng = random.Random(3)
    rows = [("r", str(i), str(rng.randrange(120)) if rng.random() < 0.9 else None) for i in range(120)]
    check(spark, rows)


def test_empty_input(spark):
    links = spark.createDataFrame([], "scope string, node string, parent string")
    assert H.resolve_forest(links).collect() == []


def test_latest_row_counts_and_nulls_are_no_nodes(spark):
    rows = [("r", "a", None, "2"), ("r", "a", "b", "1"), ("r", "a", "b", None), ("r", "b", "", "1"), ("r", "b", "", "1"), (None, "c", "a", "1"), ("r", None, "a", "1")]
    df = spark.createDataFrame(rows, "repo string, id string, up string, at string").withColumnRenamed("repo", "scope2")
    got = {(r["scope"], r["node"], r["parent"]) for r in H.latest_links(df, "scope2", "id", "up", "at").collect()}
    assert got == {("r", "a", ""), ("r", "b", "")}


def test_descendants_and_counts(spark):
    links = spark.createDataFrame([("r", "a", None), ("r", "b", "a"), ("r", "c", "b"), ("r", "z", "z")], "scope string, node string, parent string")
    paths = H.resolve_forest(links, with_path=True, with_size=True)
    assert {(r["ancestor"], r["descendant"], r["distance"]) for r in H.descendants(paths).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {(r["node"], r["path"], r["n_descendants"]) for r in H.describe(paths).collect()} == {("a", "a", 2), ("b", "a/b", 1), ("c", "a/b/c", 0), ("z", "", 0)}
