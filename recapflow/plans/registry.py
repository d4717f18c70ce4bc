"""Query registry: each query is a function of the driver tables, with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recapflow.plans.bindings import Tables, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, using: tuple[str, ...] = (), recursive: str = ""):
    """Register ``fn(tables)`` under ``name``; ``using`` names the shared SQL bindings the oracle builds on,
    ``recursive`` holds further CTEs written by the query itself."""
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_(using, sql, recursive)
        return fn

    return add
