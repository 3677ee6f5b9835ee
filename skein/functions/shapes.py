"""How results are answered: compact rows, flags and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact_hits(hits: DataFrame, group: list[str], diagnostics: bool = False) -> DataFrame:
    """Hits with ``repo`` only where the hits of a group span repositories, and without scores of sources unless asked for."""
    spans = hits.groupBy(*group).agg((F.countDistinct("repo") > 1).alias("spans")) if group else hits.agg((F.countDistinct("repo") > 1).alias("spans"))
    both = hits.join(spans, group) if group else hits.crossJoin(F.broadcast(spans))  # one row
    hidden = [] if diagnostics else [c for c in hits.columns if c.endswith("_score")]
    return both.withColumn("repo", F.when(F.col("spans"), F.col("repo"))).drop("spans", *hidden)


def compact_symbols(hits: DataFrame, with_id: bool = False) -> DataFrame:
    """Symbol hits without diagnostics; the id only on request."""
    keep = ["repo", "relative_path", "name", "kind", "container", "start_line", "end_line", "score", *(["symbol_id"] if with_id else [])]
    return compact_hits(hits.select(*[c for c in [*keep, "symbol_id"] if c in hits.columns]), []).select(*[c for c in keep if c in hits.columns])


def compact_text(hits: DataFrame) -> DataFrame:
    return compact_hits(hits.select("repo", "relative_path", "line_no", "preview"), [])


def compact_edit_target(targets: DataFrame) -> DataFrame:
    """Without hashes and diagnostics."""
    return targets.drop(*[c for c in targets.columns if c.endswith("hash") or c.endswith("_score") or c == "diagnostics"])


def place(row: Column | None = None) -> Column:
    """``repo:path:start-end``, the repository only where it is named."""
    label = F.when(F.col("repo").isNotNull(), F.concat("repo", F.lit(":"))).otherwise("")
    return F.concat(label, "relative_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))


def hit_lines(hits: DataFrame) -> DataFrame:
    """One text per hit: where it is, its score, and its snippet below."""
    head = F.concat(place(), F.lit("  "), F.format_number("score", 4))
    return hits.select(F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(head, F.lit("\n"), "snippet")).otherwise(head).alias("text"))


def summary(n: int, what: str, errors: dict[str, str] | None = None) -> str:
    """One sentence on a result, and one on what failed."""
    out = f"No {what} found." if n == 0 else f"{n} {what}{'' if n == 1 or what.endswith('s') else 's'} found."
    if errors:
        out += f" {len(errors)} repositories failed: " + "; ".join(f"{k}: {v}" for k, v in sorted(errors.items())) + "."
    return out
