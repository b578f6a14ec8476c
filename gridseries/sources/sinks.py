"""Writing zone files and prepared datasets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from gridseries.operators.splits import YEAR, Folds
from gridseries.sources.loader import NY_ZONE


def write_by_zone(df: DataFrame, folder: str, zone: str = NY_ZONE) -> None:
    """One folder of CSV files per zone.

    Rebalancing gives small zones one file each and cuts a large zone into
    several, instead of one per task and zone.
    """
    df.hint("rebalance", zone).write.partitionBy(zone).option("header", True).csv(folder)


def save_dataset(folder: str, folds: Folds, scaler: DataFrame, settings: dict) -> None:
    """Rows in a folder per year, folds as intervals of years, target scaler and settings.

    Every row is written once, whatever the number of folds. An existing folder is refused.
    """
    spark = folds.rows.sparkSession
    kept = {"settings": settings, "by": folds.by, "scaled": folds.scaled, "bits": folds.bits}
    text = spark.createDataFrame([(json.dumps(kept),)], "value string")
    text.coalesce(1).write.mode("errorifexists").text(f"{folder}/settings")
    rows = folds.rows.hint("rebalance", YEAR)
    rows.write.mode("errorifexists").partitionBy(YEAR).parquet(f"{folder}/rows")
    folds.intervals.write.mode("errorifexists").parquet(f"{folder}/folds")
    scaler.write.mode("errorifexists").parquet(f"{folder}/target_scaler")
    if folds.scalers is not None:
        folds.scalers.write.mode("errorifexists").parquet(f"{folder}/scalers")


def load_dataset(spark: SparkSession, folder: str) -> tuple[Folds, DataFrame, dict]:
    """Folds, target scaler and settings of a saved dataset; reading a fold skips the files of other years."""
    kept = json.loads(spark.read.option("wholetext", True).text(f"{folder}/settings").first()["value"])
    folds = Folds(
        spark.read.parquet(f"{folder}/rows"),
        spark.read.parquet(f"{folder}/folds"),
        tuple(kept["by"]),
        spark.read.parquet(f"{folder}/scalers") if kept["scaled"] else None,
        tuple(kept["scaled"]),
        kept["bits"],
    )
    return folds, spark.read.parquet(f"{folder}/target_scaler"), kept["settings"]
