"""Named queries: each maps (spark, sf_dir) -> DataFrame and, where the result is
expressible in SQL, carries an equivalent DuckDB query over the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prefspark.sources.fixtures import with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    surveys: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, surveys: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the
    DuckDB oracle body, prefixed with the named derived views."""

    def deco(fn):
        oracle = with_views(list(views), sql) if sql is not None else None
        QUERIES[name] = Query(name, fn, oracle, tuple(surveys.split()))
        return fn

    return deco
