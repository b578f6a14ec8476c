"""Registered queries: each operator on the driver's tables, with its SQL twin."""

from __future__ import annotations

from gridseries.catalog import experiments, files, geography, learning, series, weather


def _entries():
    for module in (series, learning, weather, geography, experiments, files):
        yield from module.QUERIES.items()


def all_queries():
    """Name -> function of (spark, folder of tables)."""
    return {key: query for key, (query, _) in _entries()}


def all_sql():
    """Name -> DuckDB SQL, for the queries SQL can express."""
    return {key: sql for key, (_, sql) in _entries() if sql is not None}


def flagship(spark, sf):
    """Repaired hourly load, seasonal-naive forecast, error per day."""
    return all_queries()["day_ahead_mape"](spark, sf)
