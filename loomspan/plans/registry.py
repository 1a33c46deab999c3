"""Where queries and their SQL are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` may use the logical ``tables`` given as common table expressions."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = sql.lstrip()
            if tables and head.upper().startswith("WITH "):
                SQL[name] = f"WITH {', '.join(tables)}, {head[5:]}"
            else:
                SQL[name] = f"WITH {', '.join(tables)} {head}" if tables else head
        return f

    return add
