"""The registry of runnable queries: name -> Spark callable, and its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``oracle`` may name views as tables."""

    def add(fn):
        def run(spark, folder):
            ship_package(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add


def load_all() -> None:
    from . import catalog_events, catalog_geometry, catalog_identity, catalog_metrics, catalog_sources  # noqa: F401
