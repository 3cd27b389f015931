"""Registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolith.plans.adapters import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(twin: str | None = None):
    """Registers a query under its function's name; twin is the SELECT of its SQL over the adapters' tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if twin is not None:
            SQL[f.__name__] = sql(twin)
        return f

    return add


def _load() -> None:
    from aerolith.plans import decision_queries, model_queries, panel_queries, source_queries, statistics_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
