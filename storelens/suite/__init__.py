"""Registered queries: each runs one operator over the given tables, with an equivalent DuckDB SQL.

The page table has no prices, social links, forms or feeds, so operators that need those run on pages
and feeds that Spark renders from the other tables, one page per row or per bounded key range.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` with its SQL twin."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load() -> None:
    from storelens.suite import base, catalog, compete, insights  # noqa: F401
