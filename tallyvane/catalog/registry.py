"""Registry of runnable queries and the plain SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(market) -> DataFrame`` under ``name``."""
    from tallyvane.sources.views import Market

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, directory: str) -> DataFrame:
            return fn(Market.open(spark, directory))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = Query(name, run, sql, tuple(covers.split()))
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    import importlib

    for module in ("prices", "ingest", "quality", "fundamentals", "macro", "risk",
                   "text", "events", "scores", "retrieval", "portfolio", "backtests", "runs",
                   "lists", "reports", "streams", "jobs", "stores", "sections"):
        importlib.import_module(f"tallyvane.catalog.{module}")
    return QUERIES
