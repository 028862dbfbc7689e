"""Registry of named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .views import Inputs, with_views

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["scalars", "rasters", "features", "elevation", "oplog", "directory", "motion", "bake", "report", "feeds", "storage"]


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` may name views, whose texts are put in front."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def load() -> None:
    for module in MODULES:
        import_module(f"{__package__}.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Inputs(spark, sf_dir))) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLES)
