"""All registered queries of the library and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("flagship", "vectors", "matching", "evaluation", "hybrid", "scans", "reports", "frames", "kernels", "outputs", "studies", "variants", "compositions", "chains")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, sf_dir), with DuckDB SQL for the same rows where SQL can express them."""

    def put(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for another way to the same rows."""
    return _SQL[name]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"matchloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
