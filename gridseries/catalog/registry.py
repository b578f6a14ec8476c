"""Collecting queries and their SQL twins by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry():
    """An empty table name -> (query, SQL or None), and the decorator that fills it."""
    queries = {}

    def register(name, sql=None):
        def keep(query):
            queries[name] = (query, sql)
            return query

        return keep

    return queries, register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns to six decimals, as in the SQL."""
    return df.withColumns({c: F.round(c, 6) for c in columns})
