"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwright.sources.graph import SQL, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, graph: bool = True):
    """Register a function of a Graph, with the SQL behind the graph's own tables."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (SQL if graph else "") + sql
        return f

    return add
