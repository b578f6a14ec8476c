"""Gazetteer of cities shown beside stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_country(places: DataFrame, country: str) -> DataFrame:
    return places.filter(F.col("ADM0_A3") == country)


def capitals(places: DataFrame) -> DataFrame:
    return places.filter(F.contains("FEATURECLA", F.lit("Admin-0")))


def largest(places: DataFrame, k: int) -> DataFrame:
    """The k most populous places; equal populations by name."""
    return places.orderBy(F.desc("POP_MIN"), "NAME").limit(k)


def main_cities(places: DataFrame, k: int = 14) -> DataFrame:
    """Capitals and the k largest, one row per name, capitals first."""
    both = capitals(places).withColumn("_branch", F.lit(0)).unionByName(
        largest(places, k).withColumn("_branch", F.lit(1))
    )
    rest = [c for c in places.columns if c != "NAME"]
    first = F.min_by(F.struct(*rest), F.struct("_branch", -F.col("POP_MIN"))).alias("_row")
    return both.groupBy("NAME").agg(first).select("NAME", "_row.*")
