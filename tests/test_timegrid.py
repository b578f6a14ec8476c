"""Row order across bucket and block borders, against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from helpers import START, column, series
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.operators import timegrid

VALUES = [float((i * 37) % 101) for i in range(400)]


@pytest.fixture(scope="module")
def gappy(spark):
    """400 rows over about 230 days, with holes."""
    return series(spark, {i * 14 + (i % 5): v for i, v in enumerate(VALUES)}).cache()


def test_row_index_counts_over_buckets(gappy):
    out = timegrid.row_index(gappy.drop("idx"), bucket=timegrid.time_bucket(F.col("Period"), 3))
    assert column(out, "idx") == list(range(400))


def test_row_index_starts_anew_per_series(spark):
    both = series(spark, range(5), series_id="a").union(series(spark, range(3), series_id="b"))
    out = timegrid.row_index(both.drop("idx")).groupBy("series_id").agg(F.max("idx").alias("m"))
    assert {r["series_id"]: r["m"] for r in out.collect()} == {"a": 4, "b": 2}


@pytest.mark.parametrize("block", [7, 50, 10000])
def test_lags_over_block_borders(gappy, block):
    out = timegrid.with_neighbours(
        gappy,
        lambda w: {"back": F.lag("TS", 5).over(w), "ahead": F.lead("TS", 3).over(w)},
        before=5,
        after=3,
        block=block,
    )
    expected = pd.Series(VALUES)
    assert out.count() == 400
    np.testing.assert_array_equal(np.array(column(out, "back"), float), expected.shift(5).values)
    np.testing.assert_array_equal(np.array(column(out, "ahead"), float), expected.shift(-3).values)


def test_carry_reaches_over_empty_buckets(spark):
    values = [None] * 60
    values[3], values[57] = 5.0, 9.0
    rows = series(spark, values, step=86400)
    out = timegrid.carry(rows, F.col("TS"), bucket=timegrid.time_bucket(F.col("Period"), 4))
    known = pd.Series(values, dtype=float)
    np.testing.assert_array_equal(np.array(column(out, "prev"), float), known.ffill().shift(1).values)
    np.testing.assert_array_equal(np.array(column(out, "next"), float), known.bfill().shift(-1).values)


def test_running_sum_over_buckets(gappy):
    out = timegrid.running_sum(gappy, F.col("TS"), "total", bucket=timegrid.time_bucket(F.col("Period"), 2))
    np.testing.assert_allclose(column(out, "total"), np.cumsum(VALUES))


def test_runs(spark):
    flags = [1, 1, 0, 0, 1, 0, 1, 1, 1]
    out = timegrid.runs(series(spark, flags), F.col("TS") == 1).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["len"]) for r in out] == [(0, 1, 2), (4, 4, 1), (6, 8, 3)]


def test_regrid_drops_off_grid_rows_and_is_idempotent(spark):
    rows = series(spark, {0: 1, 2: 2, 7: 3, 12: 4}, step=600, start=START.replace(hour=5, minute=10))
    once = timegrid.regrid(rows, 1200)
    assert column(once, "TS") == [None, None, None, None, 3, None, None]
    rows = series(spark, {0: 1, 2: 2, 7: 3, 12: 4}, step=600, start=START.replace(hour=5))
    once = timegrid.regrid(rows, 1200)
    assert column(once, "TS") == [1, 2, None, None, None, None, 4]
    assert column(once, "idx") == list(range(7))
    twice = timegrid.regrid(once, 1200)
    assert column(twice, "TS") == column(once, "TS")


def test_regrid_spans_stretches(spark):
    rows = series(spark, {0: 1.0, 5000: 2.0})
    grid = timegrid.regrid(rows, clock.HOUR)
    assert grid.count() == 5001
    tasks = timegrid.spine(timegrid.time_span(rows, clock.HOUR), clock.HOUR).rdd.getNumPartitions()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert column(grid, "idx") == list(range(5001))


def test_common_span(spark):
    both = series(spark, {0: 1, 3: 1}, series_id="a").union(series(spark, {2: 1, 6: 1}, series_id="b"))
    sizes = timegrid.regrid(both, clock.HOUR, common_span=True).groupBy("series_id").count().collect()
    assert {r["series_id"]: r["count"] for r in sizes} == {"a": 7, "b": 7}


def test_wall_clock_survives_clock_change(spark):
    """2020-03-08 02:30 does not exist in the session's time zone, but does in the data."""
    rows = series(spark, range(6), step=1800, start=START.replace(day=8, hour=1))
    floored = rows.withColumn("Period", clock.floor_to(F.col("Period"), clock.HOUR)).groupBy("Period").count()
    assert [r["Period"].hour for r in floored.orderBy("Period").collect()] == [1, 2, 3]
    assert column(timegrid.regrid(rows, 1800), "TS") == [0, 1, 2, 3, 4, 5]


def test_blocks_stay_on_the_wall_clock(spark):
    rows = series(spark, range(4), step=1800, start=START.replace(day=8, hour=2))
    out = rows.select(
        clock.horizon_block(F.col("Period"), "hour").alias("block"),
        clock.horizon_block(F.col("Period"), "week", iso_year=True).alias("week"),
        clock.clock_time(F.col("Period")).alias("time"),
    ).collect()
    assert [r["block"] for r in out] == ["2020-03-08 02"] * 2 + ["2020-03-08 03"] * 2
    assert [r["time"] for r in out] == ["02:00:00", "02:30:00", "03:00:00", "03:30:00"]
    assert out[0]["week"] == "2020-W10"


def test_all_null_series_keeps_its_rows(spark):
    from gridseries.operators import quality

    both = series(spark, [1, 2, 3], series_id="a").union(series(spark, [None, None], series_id="b"))
    for flag in (quality.flag_extremes, quality.flag_extremes_hourly, quality.flag_derivatives):
        assert flag(both).count() == 5
