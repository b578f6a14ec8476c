"""Forecast errors and the statistics reports are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.operators.quantiles import attach, exact_quantiles
from gridseries.operators.timegrid import SERIES, row_index, running_sum, with_neighbours


def mape(actual: Column, forecast: Column) -> Column:
    """Mean absolute percentage error; rows with actual = 0 have none and are skipped."""
    return F.avg(F.abs(F.try_divide(actual - forecast, actual))) * 100


def rmse(actual: Column, forecast: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - forecast, F.lit(2))))


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(actual - forecast))


METRICS = {"MAPE": mape, "RMSE": rmse, "MAE": mae}


def metric(name: str) -> Column:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; use one of {sorted(METRICS)}")
    return METRICS[name](F.col("actual"), F.col("forecast"))


def point_errors(df: DataFrame) -> DataFrame:
    """Absolute and percentage error per row; the percentage keeps the sign of the actual value."""
    abs_err = F.abs(F.col("forecast") - F.col("actual"))
    return df.withColumn("abs_err", abs_err).withColumn("error_pct", F.try_divide(abs_err, F.col("actual")) * 100)


def rebuild_levels(scored: DataFrame, load: DataFrame, by: Sequence[str]) -> DataFrame:
    """Actual and forecast load from actual and forecast differences.

    Each group starts from its true load at its first Period and adds up the
    differences that follow.
    """
    by = list(by)
    firsts = scored.groupBy(*by).agg(
        F.min("Period").alias("Period"),
        F.min_by("actual", "Period").alias("_first_actual"),
        F.min_by("forecast", "Period").alias("_first_forecast"),
    )
    keys = [k for k in by if k in load.columns] + ["Period"]
    starts = firsts.join(load.select(*keys, F.col("TS").alias("_start")), keys).drop("Period")
    out = scored
    for name in ("actual", "forecast"):
        out = running_sum(out, F.col(name), f"_sum_{name}", "Period", by)
    out = attach(out, starts, by)
    levels = {n: F.col("_start") + F.col(f"_sum_{n}") - F.col(f"_first_{n}") for n in ("actual", "forecast")}
    return out.withColumns(levels).drop(*[c for c in out.columns if c.startswith("_")])


def get_measures(df: DataFrame, period: str = "global", name: str = "MAPE", by: Sequence[str] = ()) -> DataFrame:
    """One metric over everything, or per time group."""
    if period == "global":
        return df.groupBy(*by).agg(metric(name).alias(name))
    return df.groupBy(*by, clock.period_group(F.col("Period"), period).alias(period)).agg(metric(name).alias(name))


def measures_with_global(df: DataFrame, period: str, name: str = "MAPE") -> DataFrame:
    """Per time group and overall (null group) in one pass."""
    grouped = df.withColumn(period, clock.period_group(F.col("Period"), period))
    return grouped.groupingSets([[F.col(period)], []], F.col(period)).agg(metric(name).alias(name))


def fold_summary(df: DataFrame, name: str = "MAPE", period: str = "DoY") -> DataFrame:
    """Mean over the per-(fold, time group) metrics of all folds."""
    return get_measures(df, period, name, ["fold"]).agg(F.avg(name).alias(f"mean_{name}"))


def group_metric(
    df: DataFrame,
    by: Sequence[str],
    inputs: Sequence[str],
    partial: Callable[..., Sequence[float]],
    finish: Callable[[np.ndarray], float],
    name: str = "metric",
) -> DataFrame:
    """A user's metric per group, from numbers that add up.

    `partial` gets an array for each of `inputs` with some rows of one group and returns a
    fixed number of sums; `finish` gets the sums over the whole group and returns
    the metric. Sums combine on the map side, so that a group of any size never meets in one
    task. Null inputs arrive as NaN; null keys are a group.
    """
    by = list(by)
    keys = df.select(*by).schema
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in keys]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, rows in batch.groupby(by, dropna=False, sort=False):
                sums = partial(*(rows[c].to_numpy(float) for c in inputs))
                out += [(*group, place, float(value)) for place, value in enumerate(sums)]
            frame = pd.DataFrame(out, columns=[*by, "_place", "_value"])
            yield frame.astype({c: batch[c].dtype for c in by}) if out else frame

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [float(finish(np.asarray(sums, float))) for sums in batch["_sums"]]
            yield batch[by].assign(**{name: done})

    parts = df.select(*by, *inputs).mapInPandas(add, ", ".join([*names, "_place int", "_value double"]))
    sums = parts.groupBy(*by, "_place").agg(F.sum("_value").alias("_value"))
    whole = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_place", "_value"))).alias("_sums"))
    whole = whole.withColumn("_sums", F.col("_sums._value"))
    return whole.mapInPandas(close, ", ".join([*names, f"`{name}` double"]))


STORED = ("MAPE", "RMSE")


def fold_measures(scored: DataFrame, names: Sequence[str] = STORED, period: str = "DoY") -> DataFrame:
    """Several metrics per fold, role and time group."""
    group = clock.period_group(F.col("Period"), period).alias(period)
    return scored.groupBy("fold", "role", group).agg(*[metric(n).alias(n) for n in names])


def rolling_mean(df: DataFrame, column: str, rows: int = 24, by: Sequence[str] = SERIES) -> DataFrame:
    """Trailing mean over `rows` rows, null until that many non-null values exist."""

    def trailing(window):
        frame = window.rowsBetween(1 - rows, 0)
        return {"rolling": F.when(F.count(column).over(frame) == rows, F.avg(column).over(frame))}

    indexed = df if "idx" in df.columns else row_index(df, by=by)
    return with_neighbours(indexed, trailing, before=rows - 1, by=by)


def box_stats(df: DataFrame, column: str, by: Sequence[str], outliers: bool = True) -> DataFrame:
    """Quartiles, whiskers (extreme data within 1.5 IQR of the box) and the number of outliers."""
    by = list(by)
    box = exact_quantiles(df, by, {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(column).between(F.col("q1") - reach, F.col("q3") + reach)
    measured = [
        F.min(F.when(inside, F.col(column))).alias("whisker_low"),
        F.max(F.when(inside, F.col(column))).alias("whisker_high"),
    ]
    if outliers:
        measured.append(F.count_if(~inside).alias("outliers"))
    return attach(df, box, by).groupBy(*by, "q1", "median", "q3").agg(*measured)


def density_histogram(df: DataFrame, column: str, bins: int = 25, by: Sequence[str] = SERIES) -> DataFrame:
    """Equal-width bins between minimum and maximum, normalised to area 1; the last bin is closed."""
    by = list(by)
    ends = df.groupBy(*by).agg(
        F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")
    )
    width = (F.col("high") - F.col("low")) / bins
    place = F.floor(F.try_divide(F.col(column) - F.col("low"), width)).cast("int")
    binned = attach(df.filter(F.col(column).isNotNull()), ends, by).withColumn(
        "bin", F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0))
    )
    counts = binned.groupBy(*by, "bin", "low", "high", "n").agg(F.count(F.lit(1)).alias("c"))
    return counts.select(
        *by,
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_start"),
        F.try_divide(F.col("c"), F.col("n") * width).alias("density"),
    )


def align(actual: DataFrame, forecast: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Two sources of the same series side by side, over the periods both have."""
    left = actual.select(*by, "Period", F.col("TS").alias("actual"))
    right = forecast.select(*by, "Period", F.col("TS").alias("forecast"))
    return left.join(right, [*by, "Period"])


def around_events(df: DataFrame, events: DataFrame, seconds: int = clock.DAY, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows within `seconds` of each event, with `event_period`.

    Rows and events meet on slots as wide as the reach: an event is sent to its
    own slot and the two beside it, then compared exactly.
    """
    by = list(by)
    slot = F.floor(clock.epoch_seconds(F.col("Period")) / seconds)
    sent = events.select(*by, F.col("Period").alias("event_period"), F.explode(F.sequence(slot - 1, slot + 1)).alias("_slot"))
    near = F.col("Period").between(
        clock.shift(F.col("event_period"), -seconds), clock.shift(F.col("event_period"), seconds)
    )
    return df.withColumn("_slot", slot).join(sent, [*by, "_slot"]).filter(near).drop("_slot")
