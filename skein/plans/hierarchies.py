"""Queries over the parent-child forest of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import hierarchy
from skein.runtime import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.latest_links(table(spark, d, "symbol_row"), "repo", "symbol_id", "parent_symbol_id", "indexed_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve_forest(_links(spark, d))
    return found.select(F.col("scope").alias("repo"), F.col("node").alias("symbol_id"), F.col("root").alias("root_symbol_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.describe(hierarchy.resolve_forest(_links(spark, d), with_path=True, with_size=True))
    return found.select(F.col("scope").alias("repo"), F.col("node").alias("symbol_id"), F.col("root").alias("root_symbol_id"), "depth", "path", "n_descendants")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.descendants(hierarchy.resolve_forest(_links(spark, d), with_path=True))
    return found.select(F.col("scope").alias("repo"), F.col("ancestor").alias("symbol_id"), F.col("descendant").alias("descendant_id"), "distance")


_FOREST = """
WITH RECURSIVE latest AS (
  SELECT repo, symbol_id, coalesce(parent_symbol_id, '') AS parent,
         row_number() OVER (PARTITION BY repo, symbol_id
                            ORDER BY indexed_at DESC NULLS LAST, coalesce(parent_symbol_id, '') DESC) AS rn
  FROM symbol_row WHERE repo IS NOT NULL AND symbol_id IS NOT NULL),
nodes AS (
  SELECT a.repo, a.symbol_id, b.symbol_id AS parent
  FROM (SELECT * FROM latest WHERE rn = 1) a
  LEFT JOIN (SELECT repo, symbol_id FROM latest WHERE rn = 1) b ON a.repo = b.repo AND a.parent = b.symbol_id),
walk AS (
  SELECT repo, symbol_id, symbol_id AS root_symbol_id, CAST(0 AS BIGINT) AS depth, symbol_id AS path
  FROM nodes WHERE parent IS NULL
  UNION ALL
  SELECT n.repo, n.symbol_id, w.root_symbol_id, w.depth + 1, w.path || '/' || n.symbol_id
  FROM walk w JOIN nodes n ON n.repo = w.repo AND n.parent = w.symbol_id)
"""

QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants}
SQL = {
    "p1_found": _FOREST
    + """SELECT n.repo, n.symbol_id, coalesce(w.root_symbol_id, '') AS root_symbol_id, coalesce(w.depth, -1) AS depth
FROM nodes n LEFT JOIN walk w ON n.repo = w.repo AND n.symbol_id = w.symbol_id""",
    "p1_paths": _FOREST
    + """, below AS (
  SELECT repo, unnest(string_split(path, '/')) AS symbol_id FROM walk),
counted AS (SELECT repo, symbol_id, count(*) - 1 AS n FROM below GROUP BY ALL)
SELECT n.repo, n.symbol_id, coalesce(w.root_symbol_id, '') AS root_symbol_id, coalesce(w.depth, -1) AS depth,
       coalesce(w.path, '') AS path, CAST(coalesce(c.n, 0) AS BIGINT) AS n_descendants
FROM nodes n LEFT JOIN walk w ON n.repo = w.repo AND n.symbol_id = w.symbol_id
LEFT JOIN counted c ON n.repo = c.repo AND n.symbol_id = c.symbol_id""",
    "p1_descendants": _FOREST
    + """, pairs AS (
  SELECT repo, unnest(string_split(path, '/')) AS symbol_id, unnest(range(len(string_split(path, '/')))) AS pos_,
         symbol_id AS descendant_id, depth FROM walk)
SELECT repo, symbol_id, descendant_id, CAST(depth - pos_ AS BIGINT) AS distance FROM pairs WHERE depth > pos_""",
}
