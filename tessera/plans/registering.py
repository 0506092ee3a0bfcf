"""Registers queries with their SQL."""

from __future__ import annotations


def registry():
    """(queries, SQL by name, decorator that adds a query and the SQL it must equal)."""
    queries, oracle = {}, {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
