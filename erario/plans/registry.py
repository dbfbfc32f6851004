"""Registry of the query library.

Each registered query is a function ``(spark, sf_dir) -> DataFrame`` built
from the library's operators over the driver's test tables, plus (when the
semantics are SQL-expressible) the equivalent DuckDB SQL used as the oracle.
Output columns are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def register(name: str, ids: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``ids`` names the SURVEY inventory rows."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        INVENTORY[name] = ids
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from erario.plans import audit, ingest_plans, load_plans, stream_plans, textgov_plans, window_plans  # noqa: F401
