"""Registry of named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.plans.oracle_views import with_views

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; views named in the SQL are put in front of it."""

    def add(build: Build) -> Build:
        if key in QUERIES:
            raise ValueError(f"query '{key}' is registered twice")
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return build

    return add
