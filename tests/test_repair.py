import warnings

import numpy as np
import pandas as pd
import pytest
from helpers import START, column, series
from pyspark.sql import functions as F

from gridseries.operators import features, quality, repair, timegrid


def flagged(spark, values, bad):
    return series(spark, values).withColumn("bad", F.col("idx").isin(bad))


def test_short_runs_are_interpolated_long_ones_stay(spark):
    values = [10, 0, 30, 40, 0, 0, 70, 0, 0, 0, 0, 120]
    out = repair.repair(flagged(spark, values, [1, 4, 5, 7, 8, 9, 10]))
    assert column(out, "TS") == [10, 20, 30, 40, 50, 60, 70, 0, 0, 0, 0, 120]
    assert [i for i, r in enumerate(column(out, "repaired")) if r] == [1, 4, 5]


def test_runs_at_the_ends_stay(spark):
    out = repair.repair(flagged(spark, [0, 5, 6, 0, 0], [0, 3, 4]))
    assert column(out, "TS") == [0, 5, 6, 0, 0]
    nulled = repair.repair(flagged(spark, [0, 5, 6, 0, 0], [0, 3, 4]), strategy="nan")
    assert column(nulled, "TS") == [None, 5, 6, None, None]


def test_unknown_strategy(spark):
    with pytest.raises(NotImplementedError):
        repair.repair(flagged(spark, [1], []), strategy="month_hourly_average")


def test_unflagged_rows_never_change(spark):
    values = list(np.random.default_rng(0).normal(100, 5, 500))
    for i in (20, 100, 101, 300):
        values[i] = 0.0
    values[200] = 900.0
    out = repair.fix_data(series(spark, values), ("zeros", "extremes_global", "derivatives"))
    hit = F.col("zeros") | F.col("extremes_global") | F.col("derivatives")
    kept = {r["idx"]: r["TS"] for r in out.filter(~hit).collect()}
    assert len(kept) >= 490 and all(values[i] == v for i, v in kept.items())
    fixed = {r["idx"]: r["TS"] for r in out.filter("zeros").collect()}
    assert set(fixed) == {20, 100, 101, 300}
    np.testing.assert_allclose(fixed[100], values[99] + (values[102] - values[99]) / 3)
    assert [r["idx"] for r in out.filter("extremes_global").collect()] == [200]
    counts = quality.error_counts(out).first()
    assert counts["zeros"] == 4 and counts["total"] == counts["zeros"] + counts["extremes_global"] + counts["derivatives"]


def test_unknown_fix_warns(spark):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        repair.fix_data(series(spark, [1, 2]), ("other",)).collect()
    assert any("other" in str(w.message) for w in seen)


def test_relative_change_at_zero(spark):
    out = quality.relative_changes(series(spark, [0, 0, 4, 2]))
    assert column(out, "change_back") == [None, None, 1.0, 1.0]
    assert column(out, "change_ahead") == [None, float("inf"), 0.5, None]



@pytest.mark.parametrize("limit", [1, 2, 5])
def test_interpolate_limited_equals_pandas(spark, limit):
    values = [None, 1.0, None, None, None, 9.0, 3.0, None, 5.0, None, None]
    expected = pd.Series(values, dtype=float).interpolate(method="linear", limit=limit, limit_area="inside")
    got = np.array(column(repair.interpolate_limited(series(spark, values), limit), "TS"), float)
    np.testing.assert_allclose(got, expected.values)


def test_short_gaps_all_or_nothing(spark):
    values = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    assert column(repair.fill_short_gaps(series(spark, values), 2), "TS") == [None, 1, 2, 3, 4, None, None, None, 8, None]


def test_climatology_uses_month_and_hour(spark):
    values = [float(i % 24) for i in range(24 * 5)]
    values[30] = None
    out = repair.fill_climatology(series(spark, values))
    assert column(out, "TS")[30] == 6.0


def test_merge_duplicates(spark):
    rows = [("a", START, 0.0), ("a", START, 4.0), ("a", START, 8.0)]
    df = spark.createDataFrame(rows, "series_id string, Period timestamp_ntz, TS double")
    zero = spark.createDataFrame([("b", START, 0.0), ("b", START, 0.0)], df.schema)
    out = repair.merge_duplicates(df.union(zero))
    assert {r["series_id"]: r["TS"] for r in out.collect()} == {"a": 6.0, "b": 0.0}


def test_fill_null_zero_takes_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "TS double")
    assert [r["TS"] for r in repair.fill_null_zero(df).collect()] == [1.0, 0.0, 0.0]


def test_undifference_undoes_difference(spark):
    values = list(np.random.default_rng(5).normal(size=300))
    back = features.undifference(features.difference(series(spark, values, step=86400).drop("idx")))
    np.testing.assert_allclose(column(back, "TS"), values[1:], atol=1e-12)


def test_availability(spark):
    obs = series(spark, {0: 1, 1: 1, 5: 1, 6: 1}, series_id="s").withColumnRenamed("series_id", "USAF")
    assert quality.availability(obs, 3600).first()["availability"] == 50.0


def test_modal_step_smaller_on_tie(spark):
    out = quality.modal_step(series(spark, {0: 1, 2: 1, 3: 1}, keep_idx=False)).first()
    assert (out["step"], out["n"]) == (3600, 1)


def test_hot_series_is_split_over_tasks(spark):
    """A single series is ordered in many groups, not one."""
    rows = series(spark, [1.0] * 400, step=86400)
    groups = rows.select(timegrid.time_bucket(F.col("Period")).alias("b")).distinct().count()
    assert groups > 10
