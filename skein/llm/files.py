"""Whole source files from the chunks of an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_files(chunks: DataFrame) -> DataFrame:
    """``repo, relative_path, text``: each file's distinct chunks in line order, joined by line ends.

    A repeated row (same id) counts once. Rows without path or content are left
    out; a null repo is a repo of its own. A file is one record and is held as one.
    """
    parts = chunks.where("relative_path is not null and content is not null").groupBy("repo", "relative_path").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct("start_line", "end_line", "id", "content")))).alias("parts")
    )
    return parts.select("repo", "relative_path", F.array_join(F.transform("parts", lambda x: x["content"]), "\n").alias("text"))


def path_extension(path: Column) -> Column:
    """Lower-case extension with its dot, of a path that may have blanks around it or backslashes; ``''`` if it has none."""
    name = F.element_at(F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.\s]+)$", 1))
