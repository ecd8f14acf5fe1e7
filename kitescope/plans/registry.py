"""Registered queries: Spark callables and, where SQL can say the same, the SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kitescope.plans.carriers import Carriers, duckdb_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(carriers) -> DataFrame`` under ``name``, with its SQL when given."""

    def wrap(fn: Callable[[Carriers], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Carriers(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = duckdb_ctes(sql)
        return fn

    return wrap


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for module in ("catalog", "lookup", "text", "retrieval", "network", "evaluation", "sqlpairs", "requests"):
        importlib.import_module(f"kitescope.plans.{module}_queries")
