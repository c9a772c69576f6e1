"""Registry of named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans.oracle_views import with_views

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Registers a query under its function name. ``sql`` may use the oracle views."""

    def register(build: Build) -> Build:
        name = build.__name__
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, build, with_views(sql) if sql else None)
        return build

    return register


def registered() -> dict[str, Query]:
    return dict(_QUERIES)
