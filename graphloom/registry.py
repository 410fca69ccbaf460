"""The registered queries of the graph engine, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.tables import GRAPH_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None, graph: bool = True):
    """Registers a query under its function's name; with `graph` the SQL may use the CTEs nodes and edges."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {GRAPH_SQL.strip()}\n" if graph else "") + sql
        return f

    return put
