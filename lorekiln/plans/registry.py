"""Registration of driver queries: a callable over (spark, sf_dir) and, where SQL can say it, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of one ``Model`` under ``name``."""

    def keep(f: Callable) -> Callable:
        from .proxy import Model

        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
