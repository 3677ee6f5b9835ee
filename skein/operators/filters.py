"""Filters over chunks and live files, and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

#: Beginnings of the names of collections that the engine manages.
MANAGED = ("hybrid_code_chunks_", "hybrid_symbols_", "hybrid_code_overlay_", "hybrid_symbols_overlay_")


def chunks(rows: DataFrame, file: str | None = None, prefix: str | None = None, language: str | None = None, extensions: list[str] | None = None) -> DataFrame:
    """All given conditions hold: the file as a normalized path, a plain prefix, a language, one of the extensions."""
    out = rows
    if file is not None:
        out = out.where(T.normalized_path(F.col("relative_path")) == file.strip("/"))
    if prefix is not None:
        out = out.where(F.col("relative_path").startswith(prefix))
    if language is not None:
        out = out.where(F.col("language") == language)
    if extensions:
        out = out.where(F.col("extension").isin(*extensions))
    return out


def live(path: Column, supported: list[str], language: str | None = None, extensions: list[str] | None = None) -> Column:
    """Is a live file one of a supported extension, and of the asked language and extensions?"""
    ext = T.extension(path)
    out = ext.isin(*supported)
    if language is not None:
        out = out & (T.language(ext) == language)
    return out & ext.isin(*extensions) if extensions else out


def managed(name: Column) -> Column:
    out = F.lit(False)
    for beginning in MANAGED:
        out = out | name.startswith(beginning)
    return out


def argument(value: str | None, path: bool = False, lower: bool = False) -> str | None:
    """Trimmed; blank counts as not given; a path gets plain slashes, a language lower case."""
    out = (value or "").strip()
    if path:
        out = out.replace("\\", "/").strip("/")
    return (out.lower() if lower else out) or None


def freshness_key(repo: Column, path: Column) -> Column:
    return F.concat(repo, F.lit(":"), T.normalized_path(path))
