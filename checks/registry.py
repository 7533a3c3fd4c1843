"""Collects the queries and their SQL."""

from __future__ import annotations

from editwarden.session import prepare

QUERIES = {}
SQL = {}


def check(name: str, sql: str | None = None):
    """Register ``function(spark, sf)`` under a name, with the SQL to compare it with."""
    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark, sf):
            return function(prepare(spark), sf)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function
    return add
