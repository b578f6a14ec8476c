"""Duplicates, clock changes, anomalies and gaps."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gridseries.operators.quality import DETECTORS, THRESHOLD
from gridseries.operators.timegrid import BLOCK_ROWS, SERIES, carry, with_neighbours
from gridseries.session import match, materialise

MAX_ERROR_WIDTH = 3
INTERPOLATION_LIMIT = 48
SHORT_GAP = 12
SHORT_DAY_PERIODS = 46
NORMAL_DAY_PERIODS = 48


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by the order columns.

    An aggregation, not a ranking: duplicates combine before the shuffle, so a
    key with very many copies does not fill one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def keep_last_duplicate(df: DataFrame, order: str, by: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*by, "Period").agg(F.max_by("TS", order).alias("TS"))


def merge_duplicates(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """One row per Period: the mean of its non-zero values, 0 if all are zero."""
    return df.groupBy(*by, "Period").agg(F.coalesce(F.avg(F.nullif("TS", F.lit(0.0))), F.lit(0.0)).alias("TS"))


def fill_null_zero(df: DataFrame, column: str = "TS") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.nanvl(F.col(column), F.lit(None).cast("double")), F.lit(0.0)))


def short_days(raw: DataFrame, day: str = "SETTLEMENT_DATE", size: int = SHORT_DAY_PERIODS, by=()) -> DataFrame:
    """Days with exactly `size` records."""
    return raw.groupBy(*by, day).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == size)


def fill_short_days(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """On 46-period days, periods 47 and 48 are copies of period 46."""
    keys = [*by, "SETTLEMENT_DATE"]
    last = raw.filter(F.col("SETTLEMENT_PERIOD") == SHORT_DAY_PERIODS).join(
        short_days(raw, by=by), keys, "left_semi"
    )
    missing = F.array(*[F.lit(p) for p in range(SHORT_DAY_PERIODS + 1, NORMAL_DAY_PERIODS + 1)])
    number = raw.schema["SETTLEMENT_PERIOD"].dataType
    copies = last.withColumn("SETTLEMENT_PERIOD", F.explode(missing.cast(ArrayType(number))))
    return raw.unionByName(copies.select(raw.columns))


def drop_long_days(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("SETTLEMENT_PERIOD") <= NORMAL_DAY_PERIODS)


def fix_daylight(raw: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return drop_long_days(fill_short_days(raw, by))


def repair(
    df: DataFrame,
    width: int = MAX_ERROR_WIDTH,
    strategy: str = "interpolate",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Repair runs of at most `width` rows marked `bad`; add a boolean `repaired`.

    "interpolate" draws a line by row position between the rows around the run
    and leaves runs at the ends of a series alone; "nan" sets the run to null.
    Such a run lies wholly within `width` rows of each of its rows, so the look
    around is bounded and needs no list of runs.
    """
    if strategy not in ("interpolate", "nan"):
        raise NotImplementedError(f"correction strategy {strategy!r} is not available")
    fine = F.when(~F.col("bad"), F.struct("idx", "TS"))

    def around(window):
        back, ahead = window.rowsBetween(-width, -1), window.rowsBetween(1, width)
        return {
            "_left": F.last(fine, ignorenulls=True).over(back),
            "_right": F.first(fine, ignorenulls=True).over(ahead),
            "_rows_back": F.count(F.lit(1)).over(back),
            "_rows_ahead": F.count(F.lit(1)).over(ahead),
        }

    seen = with_neighbours(df, around, before=width, after=width, by=by)
    idx, left, right = F.col("idx"), F.col("_left"), F.col("_right")
    series_start = F.when(F.col("_rows_back") < width, idx - F.col("_rows_back") - 1)
    series_end = F.when(F.col("_rows_ahead") < width, idx + F.col("_rows_ahead") + 1)
    length = F.coalesce(right["idx"], series_end) - F.coalesce(left["idx"], series_start) - 1
    short = F.col("bad") & F.coalesce(length <= width, F.lit(False))
    if strategy == "nan":
        does, value = short, F.lit(None).cast("double")
    else:
        does = short & left.isNotNull() & right.isNotNull()
        slope = (right["TS"] - left["TS"]) / (right["idx"] - left["idx"])
        value = left["TS"] + slope * (idx - left["idx"])
    return (
        seen.withColumn("repaired", does)
        .withColumn("TS", F.when(F.col("repaired"), value).otherwise(F.col("TS")))
        .drop("_left", "_right", "_rows_back", "_rows_ahead")
    )


def fix_data(
    df: DataFrame,
    fixes: Sequence[str] = ("zeros",),
    width: int = MAX_ERROR_WIDTH,
    threshold=THRESHOLD,
    strategy: str = "interpolate",
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Detect and repair in the fixed order zeros, hourly, global, derivatives.

    Every detector sees the series as the one before left it, so each stage is
    written out before the next takes its quantiles from it. One boolean column
    per kind tells the detections; `refused` marks rows that were detected but
    could not be repaired.
    """
    unknown = [f for f in fixes if f not in DETECTORS]
    if unknown:
        warnings.warn(f"unknown detectors {unknown} are ignored; known are {list(DETECTORS)}")
    wanted = [kind for kind in DETECTORS if kind in fixes]
    out = df.withColumn("refused", F.lit(False))
    for place, kind in enumerate(wanted):
        if place or kind != "zeros":
            out = materialise(out, f"fix-{kind}")
        flagged = DETECTORS[kind](out, threshold, by)
        out = (
            repair(flagged, width, strategy, by)
            .withColumn("refused", F.col("refused") | (F.col("bad") & ~F.col("repaired")))
            .withColumnRenamed("bad", kind)
            .drop("repaired")
        )
    return out


def interpolate_limited(
    df: DataFrame, limit: int = INTERPOLATION_LIMIT, by: Sequence[str] = SERIES
) -> DataFrame:
    """Linear fill between known values, but only the first `limit` nulls of each gap.

    Expects a regular grid, where `idx` is proportional to time. Gaps at either
    end of the series stay.
    """
    known = F.when(F.col("TS").isNotNull(), F.struct("idx", "TS"))
    near = carry(df, known, "idx", by, F.floor(F.col("idx") / BLOCK_ROWS), "_left", "_right")
    left, right, idx = F.col("_left"), F.col("_right"), F.col("idx")
    reach = left.isNotNull() & right.isNotNull() & (idx - left["idx"] <= limit)
    line = left["TS"] + (right["TS"] - left["TS"]) * (idx - left["idx"]) / (right["idx"] - left["idx"])
    filled = F.when(F.col("TS").isNull() & reach, line).otherwise(F.col("TS"))
    return near.withColumn("TS", filled).drop("_left", "_right")


def fill_short_gaps(df: DataFrame, limit: int = SHORT_GAP, by: Sequence[str] = SERIES) -> DataFrame:
    """Linear fill of interior gaps of at most `limit` rows; longer gaps stay whole."""
    return repair(df.withColumn("bad", F.col("TS").isNull()), limit, "interpolate", by).drop("bad", "repaired")


def month_hour_means(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Mean per year, month and hour of day."""
    return df.groupBy(
        *by, F.year("Period").alias("year"), F.month("Period").alias("month"), F.hour("Period").alias("hour")
    ).agg(F.avg("TS").alias("mean"))


def join_month_hour_mean(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Attach to each row the mean of its year, month and hour."""
    keys = [*by, "year", "month", "hour"]
    dated = (
        df.withColumn("year", F.year("Period"))
        .withColumn("month", F.month("Period"))
        .withColumn("hour", F.hour("Period"))
    )
    return match(dated, month_hour_means(df, by), keys).drop("year", "month", "hour")


def fill_climatology(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Remaining nulls become the mean of their year, month and hour, if there is one."""
    return join_month_hour_mean(df, by).withColumn("TS", F.coalesce("TS", "mean")).drop("mean")
