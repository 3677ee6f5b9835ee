"""Fusing ranked lists: reciprocal ranks with weights, plus a share of the normalized score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank offset, weight of the normalized score, and its cap.
RANK_OFFSET, SCORE_SHARE, SCORE_CAP = 100, 0.35, 1.25


def reciprocal_rank(weight: Column, rank: Column) -> Column:
    return weight / (RANK_OFFSET + rank + 1)


def fused_score(weight: Column, rank: Column, score: Column, most: Column) -> Column:
    part = F.least(F.greatest(score / most, F.lit(0.0)), F.lit(SCORE_CAP))
    return F.when(weight > 0, reciprocal_rank(weight, rank) + SCORE_SHARE * weight * part).otherwise(0.0)


def source(hits: DataFrame, name: str, weight: Column, group: list[str], k: int | None = None, tie: str = "id", floor: float | None = 1.0) -> DataFrame:
    """Rank a list within its group and score it for fusion: ``group, id, source, part``.

    The maximum that scores are divided by is at least ``floor``; without a floor
    it is the first row's score if positive, else 1.
    """
    w = Window.partitionBy(*group)
    ranked = hits.withColumn("rank", (F.row_number().over(w.orderBy(F.desc("score"), tie)) - 1).cast("long"))
    if k is not None:
        ranked = ranked.where(F.col("rank") < k)
    most = F.max("score").over(w)
    most = F.greatest(most, F.lit(floor)) if floor is not None else F.when(most > 0, most).otherwise(1.0)
    return ranked.select(*group, F.col(tie).alias("id"), F.lit(name).alias("source"), fused_score(weight, F.col("rank"), F.col("score"), most).alias("part"))


def fuse(sources: list[DataFrame], group: list[str], by_source: list[str] | None = None) -> DataFrame:
    """Sum of the parts per id: one shuffle for all sources; ``match_type`` names the source, or ``hybrid``.

    For each of ``by_source`` its own sum is given too, as ``<source>_score``, 0 where it has none.
    """
    rows = reduce(DataFrame.unionByName, sources)
    names = F.array_sort(F.collect_set(F.when(F.col("part") > 0, F.col("source"))))
    own = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col("part"))), F.lit(0.0)).alias(f"{s}_score") for s in by_source or ()]
    out = rows.groupBy(*group, "id").agg(F.sum("part").alias("score"), names.alias("names"), *own)
    kind = F.when(F.size("names") > 1, "hybrid").when(F.size("names") == 1, F.element_at("names", 1)).otherwise("unknown")
    return out.select(*group, "id", "score", kind.alias("match_type"), *(f"{s}_score" for s in by_source or ()))


def best_per_file(hits: DataFrame, group: list[str], file: list[str]) -> DataFrame:
    """The best hit of each file, by score and then id."""
    w = Window.partitionBy(*group, *file).orderBy(F.desc("score"), "id")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") == 1).drop("rn")
