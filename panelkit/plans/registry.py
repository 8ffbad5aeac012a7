"""Registry of named queries bound to the driver tables, with oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  ``sql`` is the DuckDB
statement computing the same rows over the same tables (column names equal,
order-insensitive); ``None`` marks a query without a practical SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco
