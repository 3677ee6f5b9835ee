"""The most similar vectors of every vector: vantage-point trees over metric shards.

Vectors are scaled to unit length, where Euclidean distance and cosine
similarity order alike. A small tree over a bounded sample cuts the space into
shards; every vector is stored in one shard and is a query in each shard that
the triangle inequality does not rule out. Within a shard a vantage-point tree
is searched for all its queries at once. Both prunings use the distance to the
k-th best found so far, at most that of ``least``, times ``slack``: 1 is exact
search, smaller values visit less and lose a little.

The number of shards grows with the collection, so a shard keeps its size, and the
share of shards that a query visits falls (measured at slack 0.15: 62 % of 8, 26 %
of 256, 18 % of 1,024).

Equal vectors form one class that is searched once and stands for its members. Of
a class only its first ids are shuffled (a group limit before the exchange); its
members are joined to the result by class, where adaptive execution splits the
partition of a very large one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import Stage

#: The routing tree is fitted on 64 vectors a shard; this bounds the sample to 266,240 vectors.
MOST_SHARDS = 4096
_SHARED = "shard int, part int, slice int, cls string, query boolean, base boolean, v binary"


class Tree:
    """A vantage-point tree in arrays; a leaf holds the positions ``order[start:stop]``."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = 1, leaves: int = 0):
        self.points = points
        self.leaf = leaf
        self.rng = np.random.default_rng(seed)
        self.vantage: list[np.ndarray | None] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.members: list[np.ndarray | None] = []
        self.most = leaves
        self._grow(np.arange(len(points)), leaves.bit_length() - 1 if leaves else 64)

    def _grow(self, at: np.ndarray, depth: int) -> int:
        me = len(self.cut)
        self.vantage.append(None)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        self.members.append(at)
        if len(at) <= self.leaf or depth <= 0:
            return me
        some = self.points[self.rng.choice(at, min(len(at), 256), replace=False)]
        tried = self.points[self.rng.choice(at, min(len(at), 24), replace=False)]
        spread = _distance(some @ tried.T).var(axis=0)
        v = tried[int(spread.argmax())]
        d = _distance(self.points[at] @ v)
        cut = float(np.median(d))
        near = d < cut
        if not near.any() or near.all():
            return me
        self.vantage[me], self.cut[me], self.members[me] = v, cut, None
        self.child[me] = (self._grow(at[near], depth - 1), self._grow(at[~near], depth - 1))
        return me

    def forget_points(self) -> None:
        """Keep only what routing needs, the vantage points and cuts."""
        self.points, self.members = self.points[:0], [None] * len(self.members)

    def leaves_for(self, q: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(leaf, rows of q that may have something in it, rows that live in it)``."""
        todo = [(0, np.arange(len(q)), np.ones(len(q), dtype=bool))]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            v = self.vantage[node]
            if v is None:
                yield node, rows, home
                continue
            off = _distance(q[rows] @ v) - self.cut[node]
            left, right = self.child[node]
            inner, outer = off <= radius, off >= -radius
            todo.append((left, rows[inner | (off < 0)], (home & (off < 0))[inner | (off < 0)]))
            todo.append((right, rows[outer | (off >= 0)], (home & (off >= 0))[outer | (off >= 0)]))


def _distance(similarity: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * similarity))


class Search:
    """The ``k`` nearest of a tree's points for many queries together."""

    def __init__(self, tree: Tree, queries: np.ndarray, k: int, least: float, slack: float):
        self.tree, self.q, self.k, self.slack = tree, queries, k, slack
        self.least = least - 1e-6
        self.best = np.full((len(queries), k), -2.0, dtype=np.float32)
        self.who = np.full((len(queries), k), -1, dtype=np.int64)
        self.tau = np.full(len(queries), float(_distance(np.float64(least))))
        self.compared = 0
        self._visit(0, np.arange(len(queries)))

    def _visit(self, node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        tree = self.tree
        v = tree.vantage[node]
        if v is None:
            self._scan(tree.members[node], rows)
            return
        off = _distance(self.q[rows] @ v) - tree.cut[node]
        left, right = tree.child[node]
        near = off < 0
        self._visit(left, rows[near])
        self._visit(right, rows[~near])
        reach = np.abs(off) <= self.slack * self.tau[rows]
        self._visit(right, rows[near & reach])
        self._visit(left, rows[~near & reach])

    def _scan(self, members: np.ndarray, rows: np.ndarray) -> None:
        points = self.tree.points[members]
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            s = self.q[part] @ points.T
            self.compared += s.size
            hit = s >= self.least
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            r = part[some]
            pool = np.concatenate([self.best[r], np.where(hit[some], s[some], -2.0)], axis=1)
            names = np.concatenate([self.who[r], np.broadcast_to(members, (len(r), len(members)))], axis=1)
            take = np.argpartition(-pool, self.k - 1, axis=1)[:, : self.k]
            self.best[r] = np.take_along_axis(pool, take, axis=1)
            self.who[r] = np.take_along_axis(names, take, axis=1)
            worst = self.best[r].min(axis=1)
            self.tau[r] = np.minimum(self.tau[r], np.where(worst > -1, _distance(worst.astype(np.float64)), np.inf))


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(rows: DataFrame, vec_id: str, vector: str, width: int) -> DataFrame:
    """``id, cls, v``: one row per id with a vector of ``width`` numbers, not all zero and without nulls or NaN.

    Of several vectors of one id the greatest counts. ``cls`` is equal for equal vectors.
    """
    v = F.col(vector).cast("array<float>")
    sound = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    one = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(sound).groupBy(F.col(vec_id).cast("string").alias("id")).agg(F.max(v).alias("v"))
    return one.select("id", F.concat_ws(":", F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("cls"), "v")


def neighbours(rows: DataFrame, vec_id: str, vector: str, width: int = 64, k: int = 5, least: float = 0.8, slack: float = 0.15, shard_rows: int = 12_500, query_rows: int = 100_000) -> DataFrame:
    """``id, neighbour, similarity``: for every valid id its ``k`` most similar others of at least ``least``; ties by smaller id.

    The space is cut into as many shards as ``shard_rows`` classes each make, eight
    at least and ``MOST_SHARDS`` at most, by a tree over a sample of 64 vectors a shard
    and 4,096 more. Shards that are still over four times ``shard_rows`` (by the
    sample's shares) are searched in parts, and over ``query_rows`` queries of a shard in
    slices, each slice against each part. Tables without valid vectors
    give an empty result.
    """
    spark = rows.sparkSession
    stage = Stage(spark, "vectors")
    items = stage.save(valid_vectors(rows, vec_id, vector, width))
    first = Window.partitionBy("cls").orderBy("id")
    heads = stage.save(items.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k + 1).groupBy("cls").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    n = heads.count()
    if not n:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    shards = min(MOST_SHARDS, 1 << max(3, (n // shard_rows).bit_length()))
    share = (4096 + 64 * shards) / n
    some = heads if share >= 1 else heads.where(F.xxhash64("cls") < int(share * 2**64) - 2**63)
    points = unit(np.array(some.select("v").toPandas()["v"].tolist(), dtype=np.float32)).astype(np.float32)
    if not len(points):  # a tiny share may hit none
        points = unit(np.array([heads.select("v").first()["v"]], dtype=np.float32)).astype(np.float32)
    upper = Tree(points, 1, leaves=shards)
    reach = slack * float(_distance(np.float64(least)))
    asked = {node: len(r) / len(points) * n for node, r, _ in upper.leaves_for(points, reach)}
    held = {node: int(home.sum()) / len(points) * n for node, _, home in upper.leaves_for(points, 0.0)}
    parts = {node: max(1, int(np.ceil(x / (4 * shard_rows)))) for node, x in held.items()}
    slices = {node: max(1, int(np.ceil(x / query_rows))) for node, x in asked.items()}
    upper.forget_points()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = np.array(batch.column(0).to_pylist(), dtype=object)
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.float32)
            blob = np.array([x.tobytes() for x in raw], dtype=object)
            code = np.array([int(c.split(":")[0]) & 0x7FFFFFFF for c in cls])
            for node, r, home in upper.leaves_for(unit(raw).astype(np.float32), reach):
                p, s = parts.get(node, 1), slices.get(node, 1)
                for i, j in product(range(p), range(s)):
                    query, base = code[r] // 65536 % s == j, home & (code[r] % p == i)
                    use = query | base
                    if use.any():
                        m = int(use.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, x, np.int32)) for x in (node, i, j)] + [pa.array(cls[r][use], pa.string()), pa.array(query[use]), pa.array(base[use]), pa.array(blob[r][use], pa.binary())],
                            names=["shard", "part", "slice", "cls", "query", "base", "v"],
                        )

    def search(group: pa.Table) -> pa.Table:
        x = unit(np.frombuffer(b"".join(group["v"].to_pylist()), dtype=np.float32).reshape(-1, width))
        cls = np.array(group["cls"].to_pylist(), dtype=object)
        base, query = (np.flatnonzero(group[c].to_numpy()) for c in ("base", "query"))
        if not len(base) or not len(query):
            return pa.table({"cls": pa.array([], pa.string()), "other": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        small = x.astype(np.float32)
        found = Search(Tree(small[base], 128), small[query], k + 1, least, slack)
        a, b = np.nonzero(found.who >= 0)
        q, o = query[a], base[found.who[a, b]]
        s = np.einsum("ij,ij->i", x[q], x[o])
        return pa.table({"cls": pa.array(cls[q], pa.string()), "other": pa.array(cls[o], pa.string()), "similarity": pa.array(np.round(s, 10))})

    routed = heads.select("cls", "v").mapInArrow(route, _SHARED)
    found = routed.groupBy("shard", "part", "slice").applyInArrow(search, "cls string, other string, similarity double")
    best = Window.partitionBy("cls").orderBy(F.desc("similarity"))
    near = found.where(F.col("similarity") >= least).withColumn("r", F.rank().over(best)).where(F.col("r") <= k + 1).drop("r")
    members = items.select("id", "cls")
    others = heads.select(F.col("cls").alias("other"), F.explode("ids").alias("neighbour"))
    pairs = near.join(others, "other").join(members, "cls").where("id != neighbour")
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return pairs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("id", "neighbour", "similarity")
