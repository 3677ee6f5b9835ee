"""Registered queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import code, hierarchies, scalars, scopes, search, upkeep

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = [search, scalars, code, upkeep, hierarchies, scopes]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out
