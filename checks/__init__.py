"""Queries over the given tables, each beside the SQL that must give the same rows."""


def all_checks():
    """(queries, sql) of every module."""
    from checks import aggregates, features, history, insights, jobs, joins, learning, metrics, rows, sampling  # noqa: F401
    from checks.registry import QUERIES, SQL
    return QUERIES, SQL
