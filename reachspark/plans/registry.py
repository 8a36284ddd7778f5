"""All registered queries of the analytics library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachspark.sources.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Numbers of the operator inventory that a query exercises.
COVERS: dict[str, tuple[int, ...]] = {}


def query(views: str, sql: str | None, covers: tuple[int, ...] = (), recursive: bool = False):
    """Register a function of ``Tables`` under its own name, with SQL over the named views."""

    def add(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        COVERS[name] = covers
        if sql:
            ORACLE_SQL[name] = with_views(views, sql, recursive)
        return build

    return add


from reachspark.plans import areas, choices, fares, files, graphs, measures, payloads, people, records, rules, shapes, statistics, storage, timetables, words  # noqa: E402, F401
