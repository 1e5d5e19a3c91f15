"""All named queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
MODULES = ("analytics_queries", "assessment_queries", "corpus_queries", "retrieval_queries", "stream_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        assert name not in _queries, name
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def _load() -> None:
    """Imports the query modules, each of which registers its queries."""
    for name in MODULES:
        import_module(f"textbank.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
