"""Registry of named queries: a Spark callable and (where SQL can say it) a DuckDB oracle.

Every query reads the driver tables (or views Spark derives from them) in
full. Outputs are flat scalar columns; doubles are rounded with ``r6`` on
both sides so the two engines hash the same values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from epiframe.plans import (  # noqa: F401
        queries_core, queries_episodes, queries_io, queries_more, queries_ranges, queries_recipes, queries_streams,
        queries_vectors)


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
