"""All queries of the library and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("text", "retrieval", "context", "answers", "catalog", "metrics", "files", "stream", "more", "hooks")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL that says the same."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are called {key}")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value)


def values(rows: list[tuple], columns: str) -> str:
    """Rows as a table in SQL, for queries over fixed rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"docloom.plans.{module}_queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
