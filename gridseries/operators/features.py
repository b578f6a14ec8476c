"""Columns a forecast learns from: past load, day means, calendar, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.functions.params import day_offsets, lag_rows
from gridseries.operators.quantiles import attach
from gridseries.operators.timegrid import SERIES, carry, running_sum, with_neighbours

ONE_HOT_VARS = ("Day", "DoW", "Hour", "Minute", "Month")


def to_std_fields(df: DataFrame, var: str, years: Sequence[int] | None = None, by: Sequence[str] = SERIES) -> DataFrame:
    """The chosen variable as (series, Period, TS), optionally only some years."""
    out = df.select(*by, "Period", F.col(var).cast("double").alias("TS"))
    return filter_years(out, years) if years is not None else out


def filter_years(df: DataFrame, years: Sequence[int]) -> DataFrame:
    """Rows of the requested years.

    The bounds on Period say the same as `year()` for the outer years, in a form
    that reaches the file scan.
    """
    if not years:
        return df.filter(F.lit(False))
    first = F.lit(f"{min(years):04d}-01-01").cast("timestamp_ntz")
    end = F.lit(f"{max(years) + 1:04d}-01-01").cast("timestamp_ntz")
    period = F.col("Period")
    return df.filter((period >= first) & (period < end) & F.year(period).isin(list(years)))


def distinct_years(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return df.filter(F.col("Period").isNotNull()).select(*by, F.year("Period").alias("year")).distinct()


def daily_mean(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*by, F.to_date("Period").alias("day")).agg(F.avg("TS").alias("mean"))


def join_day_offset(df: DataFrame, days: int, name: str, by: Sequence[str] = SERIES) -> DataFrame:
    """Attach the mean of the calendar day `days` before each row."""
    earlier = daily_mean(df, by).select(*by, F.date_add("day", days).alias("_day"), F.col("mean").alias(name))
    return df.withColumn("_day", F.to_date("Period")).join(earlier, [*by, "_day"], "left").drop("_day")


def add_lags(df: DataFrame, points: Sequence[str], per_hour: int, by: Sequence[str] = SERIES) -> DataFrame:
    """`Previous_<rows>` columns: the load so many rows earlier."""
    shifts = lag_rows(points, per_hour)
    if not shifts:
        return df
    return with_neighbours(
        df,
        lambda w: {f"Previous_{n}": F.lag("TS", n).over(w) for n in shifts},
        before=max(shifts),
        by=by,
    )


def add_day_means(df: DataFrame, averages: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """`Avg_<days>` columns: the mean of the calendar day so many days earlier."""
    for days in day_offsets(averages):
        df = join_day_offset(df, days, f"Avg_{days}", by)
    return df


def add_historical_ts(
    df: DataFrame,
    points: Sequence[str],
    averages: Sequence[str] | None = None,
    per_hour: int = 1,
    dropna: bool = True,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    out = add_day_means(add_lags(df, points, per_hour, by), averages or [], by)
    return out.na.drop("any") if dropna else out


def encode_time(df: DataFrame, encoding: str = "categorical") -> DataFrame:
    """Calendar columns of Period, plain ("categorical") or on the unit circle ("cyclical")."""
    encodings = {"categorical": clock.calendar_parts, "cyclical": clock.cyclical_parts}
    if encoding not in encodings:
        raise ValueError(f"unknown time encoding {encoding!r}; use one of {sorted(encodings)}")
    return df.withColumns(encodings[encoding](F.col("Period")))


def categories(df: DataFrame, variables: Sequence[str]) -> dict[str, list]:
    """Sorted distinct values of calendar variables (at most a few dozen each)."""
    found = df.agg(*[F.sort_array(F.collect_set(v)).alias(v) for v in variables]).first()
    return {v: found[v] for v in variables}


def one_hot(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """`<var>_<value>` indicator columns in sorted order, the first category of each dropped."""
    kept = [c for c in df.columns if c not in values]
    dummies: list[Column] = []
    for var in sorted(values):
        for value in values[var][1:]:
            dummies.append((F.col(var) == F.lit(value)).cast("int").alias(f"{var}_{value}"))
    return df.select(*kept, *dummies)


def encode_vars(df: DataFrame, variables: Sequence[str] = ONE_HOT_VARS) -> DataFrame:
    """One-hot encode those of `variables` that are present."""
    present = [v for v in variables if v in df.columns]
    return one_hot(df, categories(df, present)) if present else df


def select_features(df: DataFrame, targets: Sequence[str] = ("TS",), keys: Sequence[str] = ()) -> list[str]:
    """Names of the input columns: all but targets and keys, sorted."""
    return sorted(set(df.columns) - set(targets) - set(keys))


def select_by_prefix(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    """Columns whose part before the first "_" is that of one of `names`."""
    prefixes = {n.split("_")[0] for n in names}
    return [c for c in columns if c.split("_")[0] in prefixes]


def count_by_variable(columns: Sequence[str], variables: Sequence[str]) -> dict[str, int]:
    """How many columns start with each weather variable."""
    return {v: sum(c.startswith(v) for c in columns) for v in variables}


def difference(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """First differences without the first row; `start` keeps the first value of the series."""
    before = carry(df, F.struct("TS"), "Period", by, before="_before", after=None)
    start = df.groupBy(*by).agg(F.min_by("TS", "Period").alias("start"))
    changes = (
        before.filter(F.col("_before").isNotNull())
        .withColumn("TS", F.col("TS") - F.col("_before.TS"))
        .drop("_before")
    )
    return attach(changes, start, by)


def undifference(df: DataFrame, value: str = "TS", by: Sequence[str] = SERIES) -> DataFrame:
    """Rebuild values from differences and the series' `start`."""
    return running_sum(df, F.col(value), "_sum", "Period", by).withColumn(
        value, F.col("start") + F.col("_sum")
    ).drop("_sum")


def pct_change(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Percent change from the previous row."""
    before = carry(df, F.struct("TS"), "Period", by, before="_before", after=None)
    change = (F.try_divide(F.col("TS"), F.col("_before.TS")) - 1) * 100
    return before.withColumn("pct_change", change).drop("_before")
