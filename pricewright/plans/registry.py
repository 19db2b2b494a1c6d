"""Registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """Empty tables of queries and SQL, and the decorator that fills them."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return wrap

    return queries, sqls, query
