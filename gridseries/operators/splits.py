"""Train/test folds and forecast-horizon blocks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.operators.features import distinct_years
from gridseries.operators.quantiles import attach
from gridseries.operators.scaling import scale
from gridseries.operators.timegrid import SERIES

HORIZON_HOURS = {"hour": 1, "day": 24, "week": 168}


def records_per_hour(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows in the first hour of each series, and what that makes per day and week."""
    starts = df.groupBy(*by).agg(F.min("Period").alias("_start"))
    early = F.col("Period") < clock.shift(F.col("_start"), clock.HOUR)
    return (
        attach(df, starts, by)
        .groupBy(*by)
        .agg(F.count_if(early).alias("per_hour"))
        .withColumn("per_day", F.col("per_hour") * 24)
        .withColumn("per_week", F.col("per_hour") * 168)
    )


def with_blocks(df: DataFrame, horizon: str, iso_year: bool = False) -> DataFrame:
    return df.withColumn("block", clock.horizon_block(F.col("Period"), horizon, iso_year))


def complete_blocks(
    df: DataFrame,
    horizon: str,
    per_hour: int = 1,
    by: Sequence[str] = SERIES,
    iso_year: bool = False,
) -> DataFrame:
    """Rows of blocks that hold exactly the nominal number of rows."""
    keys = [*by, "block"]
    blocks = with_blocks(df, horizon, iso_year)
    sizes = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.filter(F.col("n") == HORIZON_HOURS[horizon] * per_hour)
    return blocks.join(whole, keys, "left_semi")


def block_mask(
    df: DataFrame, lags: Sequence[int], block_rows: int, unknown: float | None = 0.0, by: Sequence[str] = SERIES
) -> DataFrame:
    """Hide past load a forecast could not know: inside a block, lag p is unknown from offset p on.

    Blocks of `block_rows` are counted from the first row of each group given, as for a test set.
    """
    df = attach(df, df.groupBy(*by).agg(F.min("idx").alias("_first")), by)
    offset = F.pmod(F.col("idx") - F.col("_first"), F.lit(block_rows))
    hidden = {
        f"Previous_{p}": F.when(offset >= p, F.lit(unknown).cast("double")).otherwise(F.col(f"Previous_{p}"))
        for p in lags
    }
    return df.withColumns(hidden).drop("_first")


def fold_years(df: DataFrame, train_test: tuple[int, int], by: Sequence[str] = SERIES) -> DataFrame:
    """(series, year, fold, role): windows of train and test years sliding by one year."""
    train, test = train_test
    in_order = Window.partitionBy(*by).orderBy("year")
    years = distinct_years(df, by).withColumn("_rank", F.row_number().over(in_order) - 1)
    years = years.withColumn("_years", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    last_fold = F.col("_years") - (train + test)
    first = F.greatest(F.col("_rank") - (train + test - 1), F.lit(0))
    until = F.least(F.col("_rank"), last_fold)
    return (
        years.filter(first <= until)
        .withColumn("fold", F.explode(F.sequence(first, until)))
        .withColumn("role", F.when(F.col("_rank") < F.col("fold") + train, "train").otherwise("test"))
        .select(*by, "year", "fold", "role")
    )


def fold_intervals(years: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """(series, fold, role, first_year, last_year): the folds as intervals over the years that have data."""
    return years.groupBy(*by, "fold", "role").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


YEAR = "fold_year"


def with_year(df: DataFrame) -> DataFrame:
    """Adds the year that folds are cut by; rows without a Period have none and take part in no fold."""
    return df.withColumn(YEAR, F.year("Period"))


@dataclass(frozen=True)
class Folds:
    """Train/test folds over rows that are kept once.

    `rows` has each row once, with its `fold_year`, best stored in a folder per
    year; `intervals` comes from `fold_intervals`. `scalers`, if given, are
    parameters per (series, fold) for the named columns, applied when rows are read;
    `bits` is the precision of these columns.
    """

    rows: DataFrame
    intervals: DataFrame
    by: tuple[str, ...] = SERIES
    scalers: DataFrame | None = None
    scaled: tuple[str, ...] = ()
    bits: int = 64

    def years(self) -> DataFrame:
        """(series, year, fold, role), a row for each year of each fold."""
        each = F.explode(F.sequence("first_year", "last_year")).alias("year")
        return self.intervals.select(*self.by, each, "fold", "role")

    def all(self) -> DataFrame:
        """Every row once for each fold it takes part in, with `fold` and `role`."""
        joined = attach(self.rows, self.years().withColumnRenamed("year", YEAR), [*self.by, YEAR]).drop(YEAR)
        if self.scalers is None:
            return joined
        scaled = scale(joined, self.scalers, self.scaled, [*self.by, "fold"])
        return cast_precision(scaled, self.scaled, self.bits)

    def part(self, fold: int | None = None, role: str | None = None) -> DataFrame:
        """The rows of one fold or one role; files of other years are not read.

        The years of a fold reach the driver, a number bounded by the years of data.
        """
        wanted = self.intervals
        if fold is not None:
            wanted = wanted.filter(F.col("fold") == fold)
        if role is not None:
            wanted = wanted.filter(F.col("role") == role)
        years = replace(self, intervals=wanted).years().select("year").distinct().collect()
        rows = self.rows.filter(F.col(YEAR).isin([row["year"] for row in years]))
        return replace(self, rows=rows, intervals=wanted).all()

    def numbers(self) -> list[int]:
        """The folds there are."""
        return sorted(row["fold"] for row in self.intervals.select("fold").distinct().collect())


def fold_rows(df: DataFrame, train_test: tuple[int, int] = (2, 1), by: Sequence[str] = SERIES) -> Folds:
    """Folds of sliding windows of years over `df`."""
    return Folds(with_year(df), fold_intervals(fold_years(df, train_test, by), by), tuple(by))


def cv_splits(df: DataFrame, train_test: tuple[int, int] = (2, 1), by: Sequence[str] = SERIES) -> DataFrame:
    """Every row once per fold it takes part in, with `fold` and `role`."""
    return fold_rows(df, train_test, by).all()


def block_tensor(
    df: DataFrame,
    features: Sequence[str],
    horizon: str,
    per_hour: int = 1,
    by: Sequence[str] = SERIES,
    target: str = "TS",
) -> DataFrame:
    """One row per complete block: `x` holds its rows of features in time order, `y` its targets.

    Only complete blocks are gathered, so a block has the nominal size at most.
    """
    rows = complete_blocks(df, horizon, per_hour, by)
    values = F.array(*[F.col(f).cast("double") for f in features])
    gathered = F.array_sort(F.collect_list(F.struct(F.col("Period"), values.alias("x"), F.col(target).alias("y"))))
    return (
        rows.groupBy(*by, "block")
        .agg(gathered.alias("_rows"))
        .select(
            *by,
            "block",
            F.transform("_rows", lambda r: r["x"]).alias("x"),
            F.transform("_rows", lambda r: r["y"]).alias("y"),
        )
    )


def tensor_shape(tensor: DataFrame) -> tuple[int, int, int]:
    """(blocks, steps, features) of a block tensor."""
    shape = tensor.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.max(F.size("x")), F.lit(0)).alias("steps"),
        F.coalesce(F.max(F.size(F.col("x")[0])), F.lit(0)).alias("features"),
    ).first()
    return shape["blocks"], shape["steps"], shape["features"]


def cast_precision(df: DataFrame, columns: Sequence[str], bits: int = 64) -> DataFrame:
    if bits not in (32, 64):
        raise ValueError("precision is 32 or 64 bits")
    type_ = "float" if bits == 32 else "double"
    return df.withColumns({c: F.col(c).cast(type_) for c in columns})
