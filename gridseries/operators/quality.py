"""Anomaly detectors. Each adds a boolean `bad` column to a series with `idx`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.operators.quantiles import attach, exact_quantiles
from gridseries.operators.timegrid import BLOCK_ROWS, SERIES, carry, time_bucket
from gridseries.session import materialise

THRESHOLD = (1.5, 0.99)


def outside(value: Column, low: Column, high: Column, factor: float) -> Column:
    """Above `factor` times the high quantile or below the low quantile over `factor`.

    For a negative low quantile the lower limit moves towards zero.
    """
    return F.coalesce((value > high * factor) | (value < low / factor), F.lit(False))


def flag_zeros(df: DataFrame) -> DataFrame:
    return df.withColumn("bad", F.coalesce(F.col("TS") == 0, F.lit(False)))


def quantile_limits(df: DataFrame, q: float, by: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, by, {"low": ("TS", 1 - q), "high": ("TS", q)})


def flag_extremes(df: DataFrame, threshold=THRESHOLD, by: Sequence[str] = SERIES) -> DataFrame:
    factor, q = threshold
    judged = attach(df, quantile_limits(df, q, by), by, "left")
    return judged.withColumn("bad", outside(F.col("TS"), F.col("low"), F.col("high"), factor)).drop("low", "high")


def join_hour_limits(df: DataFrame, q: float, by: Sequence[str] = SERIES) -> DataFrame:
    """Attach the quantiles of the row's hour of day as `low` and `high`."""
    keys = [*by, "hour"]
    hourly = df.withColumn("hour", F.hour("Period"))
    return attach(hourly, quantile_limits(hourly, q, keys), keys, "left")


def flag_extremes_hourly(df: DataFrame, threshold=THRESHOLD, by: Sequence[str] = SERIES) -> DataFrame:
    factor, q = threshold
    judged = join_hour_limits(df, q, by)
    return judged.withColumn("bad", outside(F.col("TS"), F.col("low"), F.col("high"), factor)).drop(
        "low", "high", "hour"
    )


def relative_change(value: Column, other: Column) -> Column:
    """|value - other| / |value|; infinite for a change away from zero, null for zero against zero."""
    change = F.abs(F.try_divide(value - other, value))
    return F.when((value == 0) & (other != 0), F.lit(float("inf"))).otherwise(change)


def relative_changes(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Add `change_back` and `change_ahead`, the relative changes to the neighbouring rows."""
    near = carry(
        df, F.struct("TS"), "idx", by, F.floor(F.col("idx") / BLOCK_ROWS), before="_before", after="_after"
    )
    return (
        near.withColumn("change_back", relative_change(F.col("TS"), F.col("_before.TS")))
        .withColumn("change_ahead", relative_change(F.col("TS"), F.col("_after.TS")))
        .drop("_before", "_after")
    )


def flag_derivatives(df: DataFrame, threshold=THRESHOLD, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows that jump away from both neighbours by more than the usual largest change."""
    factor, q = threshold
    changes = materialise(relative_changes(df, by), "changes")
    limits = exact_quantiles(changes, by, {"usual_back": ("change_back", q), "usual_ahead": ("change_ahead", q)})
    both = (F.col("change_back") > F.col("usual_back") * factor) & (
        F.col("change_ahead") > F.col("usual_ahead") * factor
    )
    return (
        attach(changes, limits, by, "left")
        .withColumn("bad", F.coalesce(both, F.lit(False)))
        .drop("change_back", "change_ahead", "usual_back", "usual_ahead")
    )


DETECTORS = {
    "zeros": lambda df, threshold, by: flag_zeros(df),
    "extremes_hourly": flag_extremes_hourly,
    "extremes_global": flag_extremes,
    "derivatives": flag_derivatives,
}


def error_counts(fixed: DataFrame) -> DataFrame:
    """Detections per kind and in total over the flag columns `fix_data` leaves."""
    kinds = [k for k in DETECTORS if k in fixed.columns]
    counts = [F.count_if(F.col(k)).alias(k) for k in kinds]
    total = sum((F.col(k) for k in kinds), F.lit(0))
    return fixed.agg(*counts).withColumn("total", total)


def gap_lengths(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Seconds since the previous row of the series, null on its first row."""
    before = carry(df, F.col("Period"), "Period", by, before="_before", after=None)
    step = clock.epoch_seconds(F.col("Period")) - clock.epoch_seconds(F.col("_before"))
    return before.withColumn("step", step).drop("_before")


def modal_step(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Most frequent step of each series, the smaller one on a tie."""
    by = list(by)
    counts = gap_lengths(df, by).filter(F.col("step").isNotNull()).groupBy(*by, "step").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy(*by).agg(
        F.max_by("step", F.struct(F.col("n"), -F.col("step"))).alias("step"), F.max("n").alias("n")
    )


def availability(obs: DataFrame, max_gap: int, by: Sequence[str] = ("USAF",)) -> DataFrame:
    """Share (percent) of a station's rows that follow the previous one within `max_gap` seconds."""
    by = list(by)
    at = clock.epoch_seconds(F.col("Period"))
    rows = obs.select(*by, at.alias("_at"), time_bucket(F.col("Period")).alias("_bucket"))
    step = F.col("_at") - F.lag("_at").over(Window.partitionBy(*by, "_bucket").orderBy("_at"))
    # One summary per bucket of time; summaries of neighbouring buckets add up, and one step joins them.
    parts = rows.withColumn("_good", step <= max_gap).groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("_good").alias("_steps"),
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
    )
    earlier = F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket"))
    joined = parts.withColumn("_joined", (F.col("_first") - earlier <= max_gap).cast("int"))
    good = F.sum(F.col("_steps") + F.coalesce("_joined", F.lit(0)))
    return joined.groupBy(*by).agg((good * 100.0 / F.sum("_rows")).alias("availability"))


def null_share(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.avg(F.col("TS").isNull().cast("int")) * 100).alias("null_pct"))


def drop_sparse(df: DataFrame, min_quality: float, by: Sequence[str]) -> DataFrame:
    """Keep series with at most 100 - `min_quality` percent nulls."""
    good = null_share(df, by).filter(F.col("null_pct") <= 100.0 - min_quality)
    return attach(df, good, by, "left_semi")
