"""Operators bound to the tables under an ``sf_dir``, each next to its ANSI SQL form."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "history",
    "texts",
    "studies",
    "labels",
    "metrics",
    "vectors",
    "diseases",
    "graphs",
    "candidates",
    "files",
    "streams",
)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without ``sql`` it is tested against brute force instead."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return dict(_QUERIES), dict(_SQL)
