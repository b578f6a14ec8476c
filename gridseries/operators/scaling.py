"""Scalers as parameter tables: one row of centres and scales per series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.functions.search import count_below
from gridseries.operators.quantiles import attach, exact_quantiles, quantile_grid
from gridseries.operators.timegrid import SERIES

QUANTILE_POINTS = 1000

# The scaler names a user may choose.
SCALERS = ("MaxAbsScaler", "MinMaxScaler", "Normalizer", "QuantileTransformer", "RobustScaler", "StandardScaler")


def _spread(scale: Column) -> Column:
    """A constant column has no spread and is only centred."""
    return F.when(scale == 0, 1.0).otherwise(scale)


def fit_scaler(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "RobustScaler",
    by: Sequence[str] = SERIES,
    points: int = QUANTILE_POINTS,
) -> DataFrame:
    """Parameters per series: `<column>__center` and `<column>__scale`, or `<column>__grid`."""
    by = list(by)
    if method not in SCALERS or method == "Normalizer":
        raise ValueError(f"{method!r} has no parameters to fit; use one of {sorted(set(SCALERS) - {'Normalizer'})}")
    if method == "QuantileTransformer":
        return _fit_grids(df, columns, by, points)
    if method == "RobustScaler":
        wanted = {}
        for c in columns:
            wanted |= {f"{c}__q25": (c, 0.25), f"{c}__center": (c, 0.5), f"{c}__q75": (c, 0.75)}
        found = exact_quantiles(df, by, wanted)
        spreads = [_spread(F.col(f"{c}__q75") - F.col(f"{c}__q25")).alias(f"{c}__scale") for c in columns]
        return found.select(*by, *[f"{c}__center" for c in columns], *spreads)
    measures = {
        "MinMaxScaler": lambda c: (F.min(c), F.max(c) - F.min(c)),
        "StandardScaler": lambda c: (F.avg(c), F.stddev_pop(c)),
        "MaxAbsScaler": lambda c: (F.lit(0.0), F.max(F.abs(c))),
    }[method]
    stats = []
    for c in columns:
        center, scale = measures(c)
        stats += [center.cast("double").alias(f"{c}__center"), _spread(scale).alias(f"{c}__scale")]
    return df.groupBy(*by).agg(*stats)


def _fit_grids(df: DataFrame, columns: Sequence[str], by: list[str], points: int) -> DataFrame:
    """`<column>__grid` of all columns from one pass: every (group, column) is ranked as a group of its own."""
    values = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    long = df.select(*by, F.inline(F.array(*values)))
    grids = quantile_grid(long, "_value", points, [*by, "_column"])
    own = [F.first(F.when(F.col("_column") == c, F.col("grid")), ignorenulls=True).alias(f"{c}__grid") for c in columns]
    return grids.groupBy(*by).agg(*own)


def _to_uniform(value: Column, grid: Column, points: int) -> Column:
    """Where a value lies on the fitted quantiles, 0 to 1; repeated quantiles count half way."""
    below = count_below(grid, value, points, inclusive=False)
    upto = count_below(grid, value, points, inclusive=True)
    left, right = F.get(grid, below - 1), F.get(grid, below)
    between = (below - 1 + (value - left) / (right - left)) / (points - 1)
    return (
        F.when(value <= F.get(grid, F.lit(0)), 0.0)
        .when(value >= F.get(grid, F.lit(points - 1)), 1.0)
        .when(upto > below, (below + upto - 1) / 2 / (points - 1))
        .otherwise(between)
    )


def _from_uniform(share: Column, grid: Column, points: int) -> Column:
    place = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (points - 1)
    low = F.floor(place).cast("int")
    left = F.get(grid, low)
    right = F.coalesce(F.get(grid, low + 1), left)
    return left + (right - left) * (place - low)


def _apply(df, params, columns, by, grid_value, plain_value) -> DataFrame:
    with_grid = f"{columns[0]}__grid" in params.columns
    joined = attach(df, params, by, "left")
    updates = {}
    for c in columns:
        if with_grid:
            updates[c] = grid_value(F.col(c), F.col(f"{c}__grid"))
        else:
            updates[c] = plain_value(F.col(c), F.col(f"{c}__center"), F.col(f"{c}__scale"))
    return joined.withColumns(updates).drop(*[c for c in params.columns if c not in by])


def scale(df, params, columns: Sequence[str], by: Sequence[str] = SERIES, points: int = QUANTILE_POINTS) -> DataFrame:
    return _apply(
        df, params, columns, by, lambda v, g: _to_uniform(v, g, points), lambda v, center, spread: (v - center) / spread
    )


def unscale(df, params, columns: Sequence[str], by: Sequence[str] = SERIES, points: int = QUANTILE_POINTS) -> DataFrame:
    return _apply(
        df, params, columns, by, lambda v, g: _from_uniform(v, g, points), lambda v, center, spread: v * spread + center
    )


def rename_params(params: DataFrame, old: str, new: str) -> DataFrame:
    """The parameters of column `old`, for use on a column called `new` (a prediction)."""
    renames = {c: c.replace(f"{old}__", f"{new}__", 1) for c in params.columns if c.startswith(f"{old}__")}
    return params.withColumnsRenamed(renames)


def normalize_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each row to length 1 over `columns`; rows of zeros stay."""
    length = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in columns]))
    out = df.withColumn("_length", F.when(length == 0, 1.0).otherwise(length))
    return out.withColumns({c: F.col(c) / F.col("_length") for c in columns}).drop("_length")
