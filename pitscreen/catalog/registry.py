"""Registry of runnable queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitscreen.catalog.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


_LANDED: dict[tuple[str, str], object] = {}


def tables(spark: SparkSession, sf_dir: str):
    """Input tables of a data directory, landed once per Spark application."""
    from pitscreen.sources.standin import Tables

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LANDED:
        _LANDED[key] = Tables(spark, sf_dir).landed()
    return _LANDED[key]


def query(name: str, covers: str, sql: str | None = None, views: str = ""):
    """Registers ``fn(tables) -> DataFrame`` under ``name``.

    ``covers`` lists the inventory rows the query exercises; ``views`` the SQL views its
    equivalent reads.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        COVERS[name] = tuple(covers.split())
        if sql is not None:
            SQL[name] = with_views(views.split(), sql)
        return fn

    return register
