"""One ranking from several differently scaled scores.

Scores are replaced by ranks within (query, list), so neither scale nor an
extreme value decides. The weights are the loadings of the first principal
component of the rank-transformed scores: one distributed pass accumulates the
moments of the correlation matrix, whose size is the number of lists and not of
rows; its leading eigenvector is taken on the driver and each loading is turned
to the declared direction of its list. Items are sorted by their projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_transform(hits: DataFrame, group: str, item: str, score: str, higher: bool = True) -> DataFrame:
    """``group, item, value``: the item's rank from the bottom over the number of scored items, in (0, 1].

    Repeated rows of an item count once, by their best score. Null and NaN scores
    are not scored and give no row. Ties share the mean of their ranks.
    """
    sign = 1.0 if higher else -1.0
    best = (
        hits.where(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(group).alias("group"), F.col(item).alias("item"))
        .agg(F.max(F.col(score).cast("double") * sign).alias("s"))
    )
    w = Window.partitionBy("group")
    ranked = best.withColumn("low", F.rank().over(w.orderBy("s"))).withColumn("n", F.count(F.lit(1)).over(w))
    ties = F.count(F.lit(1)).over(Window.partitionBy("group", "s"))
    return ranked.withColumn("value", (F.col("low") + (ties - 1) / 2) / F.col("n")).select("group", "item", "value")


def _correlation(a: Column, b: Column) -> Column:
    """Null where either does not vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def loadings(wide: DataFrame, columns: list[str], directions: list[int] | None = None) -> np.ndarray:
    """Loadings of the first principal component of ``columns``, turned to ``directions`` (+1 or -1).

    Of two equally strong components (uncorrelated lists) the even mix is taken.
    """
    k = len(columns)
    want = np.array(directions or [1] * k, dtype=float)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    row = wide.agg(F.count(F.lit(1)).alias("n"), *(_correlation(F.col(columns[i]), F.col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs)).first() if pairs else None
    matrix = np.eye(k)
    for i, j in pairs:
        c = row[f"c{i}_{j}"]
        matrix[i, j] = matrix[j, i] = 0.0 if c is None or np.isnan(c) else c
    values, vectors = np.linalg.eigh(matrix)
    top = values >= values[-1] - 1e-9
    even = vectors[:, top] @ (vectors[:, top].T @ want)
    first = even if np.linalg.norm(even) > 1e-9 else vectors[:, -1]
    return np.abs(first / np.linalg.norm(first)) * want


def disagreeing(wide: DataFrame, columns: list[str], directions: list[int] | None = None) -> list[str]:
    """Columns that run against the mean of all others (in the declared directions); ``loadings`` turns them all the same."""
    if len(columns) < 2:
        return []
    signs = dict(zip(columns, directions or [1] * len(columns), strict=True))
    row = wide.agg(*(_correlation(F.col(c) * signs[c], sum((F.col(o) * signs[o] for o in columns if o != c), F.lit(0.0))).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] < 0]


def fuse(lists: list[DataFrame], directions: list[int] | None = None) -> DataFrame:
    """``group, item, projection`` from rank-transformed lists; an item absent from a list gets 0 from it.

    With no lists' rows at all the result is empty.
    """
    wide = None
    names = [f"v{i}" for i in range(len(lists))]
    tagged = [x.select("group", "item", F.lit(i).alias("list"), "value") for i, x in enumerate(lists)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    wide = rows.groupBy("group", "item").agg(*(F.coalesce(F.max(F.when(F.col("list") == i, F.col("value"))), F.lit(0.0)).alias(n) for i, n in enumerate(names)))
    weights = loadings(wide, names, directions)
    projection = sum((F.col(n) * float(w) for n, w in zip(names, weights, strict=True)), F.lit(0.0))
    return wide.select("group", "item", F.round(projection, 12).alias("projection"))


def top_items(fused: DataFrame, limits: DataFrame) -> DataFrame:
    """The first ``top_n`` items of each group of ``limits(group, top_n)``; ties by smaller item.

    A null or non-positive ``top_n`` gives no row. A group is one query's hits.
    """
    per = limits.groupBy("group").agg(F.max("top_n").alias("top_n"))
    w = Window.partitionBy("group").orderBy(F.desc("projection"), "item")
    return fused.withColumn("position", F.row_number().over(w).cast("long")).join(per, "group").where("position <= top_n").select("group", "item", "position", "projection")
