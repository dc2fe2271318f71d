"""Queries by name, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated (spark, sf_dir) -> DataFrame function under ``name``."""

    def add(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def handler(name: str) -> Callable[..., DataFrame]:
    """The function that ``module:function`` names; an error tells what is missing."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError(f"{name} is not of the form module:function")
    found = getattr(importlib.import_module(module), function, None)
    if not callable(found):
        raise ValueError(f"{module} has no function {function}")
    return found


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
