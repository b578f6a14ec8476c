import io
from contextlib import redirect_stdout

import numpy as np
import pandas as pd
import pytest
from helpers import column, series
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gridseries.functions import params
from gridseries.operators import evaluate, features, forecast, runs, splits


def test_lag_specs():
    assert params.lag_rows(["7d", "1-3h", "5r", "2x", "bad"], 2) == [336, 2, 4, 6, 5]
    assert params.day_offsets(["1d", "7d", "3h"]) == [1, 7]


def test_size_specs():
    assert params.layer_size("128", 10) == 128
    assert params.layer_size("1.5X", 10) == 15
    assert params.size_range("10-4X", 4, 10) == [10, 20, 30, 40]


def test_sweep_values():
    assert params.sweep_values((1, 10, 4)) == [1, 4, 7, 10]
    assert params.sweep_values((1.0, 2.0, 3)) == [1.0, 1.5, 2.0]
    assert params.spaced(1, 8, 4) == [1, 3, 5, 8]
    assert params.sweep_values(var_list=["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        params.sweep_values(var_list=["a", 1])


def test_day_mean_follows_the_calendar_not_rows(spark):
    rows = series(spark, {k: float(k) for k in range(72) if not 24 <= k < 40})
    out = features.add_day_means(rows, ["1d"])
    means = {r["Period"].day: r["Avg_1"] for r in out.collect()}
    assert means == {1: None, 2: np.mean(range(24)), 3: np.mean(range(40, 48))}


def test_one_hot_drops_first_category(spark):
    out = features.encode_vars(features.encode_time(series(spark, range(48))), ["DoW", "Hour"])
    assert "Hour_0" not in out.columns and "Hour_23" in out.columns and "DoW" not in out.columns
    assert out.agg(F.sum("Hour_5")).first()[0] == 2


def test_filter_years_reaches_the_scan(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderdate", "Period")
    with redirect_stdout(io.StringIO()) as plan:
        features.filter_years(orders, [1996, 1997]).explain("formatted")
    pushed = next(line for line in plan.getvalue().splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in pushed and "LessThan(o_orderdate,1998-01-01" in pushed


def years(spark, first, last):
    rows = spark.range((last - first + 1) * 12).select(
        F.lit("a").alias("series_id"),
        F.make_timestamp_ntz(
            (F.lit(first) + F.floor(F.col("id") / 12)).cast("int"), (F.col("id") % 12 + 1).cast("int"),
            F.lit(1), F.lit(0), F.lit(0), F.lit(0),
        ).alias("Period"),
        F.col("id").cast("double").alias("TS"),
    )
    return rows


def test_folds_slide_by_a_year(spark):
    out = splits.cv_splits(years(spark, 2000, 2005), (2, 1))
    seen = out.groupBy("fold", "role").agg(F.sort_array(F.collect_set(F.year("Period"))).alias("y")).collect()
    got = {(r["fold"], r["role"]): r["y"] for r in seen}
    assert len(got) == 8
    for fold in range(4):
        assert got[(fold, "train")] == [2000 + fold, 2001 + fold]
        assert got[(fold, "test")] == [2002 + fold]
    assert splits.cv_splits(years(spark, 2000, 2001), (2, 1)).count() == 0


def test_mask_hides_only_unknown_lags(spark):
    rows = series(spark, range(1, 13)).withColumns({"Previous_1": F.lit(9.0), "Previous_3": F.lit(9.0)})
    out = splits.block_mask(rows, [1, 3], 4)
    assert column(out, "Previous_1") == [9, 0, 0, 0] * 3
    assert column(out, "Previous_3") == [9, 9, 9, 0] * 3


def test_block_tensor_shape(spark):
    rows = series(spark, range(24 * 3 + 5)).withColumn("x", F.col("TS") * 2)
    tensor = splits.block_tensor(rows, ["TS", "x"], "day")
    assert splits.tensor_shape(tensor) == (3, 24, 2)
    first = tensor.orderBy("block").first()
    assert first["x"][1] == [1.0, 2.0] and first["y"][:3] == [0.0, 1.0, 2.0]


def lagged(spark):
    values = np.random.default_rng(0).normal(100, 10, 24 * 6)
    rows = features.add_lags(series(spark, values), ["1r", "24r"], 1).na.drop()
    return rows.withColumn("fold", F.lit(0))


def test_recurrent_scoring_equals_plain_loop(spark):
    rows = lagged(spark)
    weights = {"intercept": F.lit(5.0), "Previous_1": F.lit(0.5), "Previous_24": F.lit(0.25)}
    out = forecast.predict_recurrent(rows, weights, [1, 24]).orderBy("Period").collect()
    want = []
    for _, day in rows.orderBy("Period").toPandas().groupby(lambda i: i // 24):
        done = []
        for i, r in enumerate(day.itertuples()):
            back = done[i - 1] if i else r.Previous_1
            done.append(5 + 0.5 * back + 0.25 * r.Previous_24)
        want += done
    np.testing.assert_allclose([r["forecast"] for r in out], want)

    def predict(rows: pd.DataFrame) -> pd.Series:
        return 5 + 0.5 * rows["Previous_1"] + 0.25 * rows["Previous_24"]

    same = forecast.predict_recurrent_with(rows, predict, ["Previous_1", "Previous_24"], [1, 24])
    np.testing.assert_allclose(column(same, "forecast"), want)


def test_any_estimator(spark):
    folds = lagged(spark).withColumn("role", F.when(F.col("idx") < 100, "train").otherwise("test"))
    models = forecast.train_per_fold(folds, GBTRegressor(maxIter=2, seed=1), ["Previous_1", "Previous_24"])
    scored = forecast.predict_direct(folds, models, ["series_id", "Period", "TS"])
    assert scored.filter(F.col("forecast").isNull()).count() == 0
    out = forecast.evaluate_folds(scored.withColumnRenamed("TS", "actual"))
    assert {r["role"] for r in out.collect()} == {"train", "test"}


def test_metrics_skip_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 11.0)], "actual double, forecast double")
    assert evaluate.get_measures(df).first()["MAPE"] == pytest.approx(10.0)
    assert evaluate.point_errors(df).filter("error_pct is null").count() == 1
    with pytest.raises(ValueError):
        evaluate.metric("other")


def test_box_whiskers(spark):
    values = [1.0, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    out = evaluate.box_stats(df, "v", ["g"]).first()
    assert (out["q1"], out["median"], out["q3"]) == (3.0, 5.0, 7.0)
    assert (out["whisker_low"], out["whisker_high"], out["outliers"]) == (1.0, 8.0, 1)


def test_histogram_has_area_one_and_closed_last_bin(spark):
    out = evaluate.density_histogram(series(spark, range(101)), "TS", 10).orderBy("bin").collect()
    assert sum(r["density"] * 10 for r in out) == pytest.approx(1.0)
    assert out[-1]["density"] == pytest.approx(11 / 1010)


def test_run_ids_start_at_zero_and_store_reads_back(spark, tmp_path):
    store = str(tmp_path / "store")
    arch = '{"config":[{"class_name":"CNN","config":{"filters":8}},{"class_name":"Dense","config":{"units":1}}]}'
    settings = {
        "Model": {"arch": arch, "optimizer": {"optimizer_name": "Adam", "lr": 0.1, "decay": None}},
        "ML_Preprocessor": {"train_test": [6, 2], "historical_ts": {"points": ["1d"], "averages": []}},
        "Data": {"location": "UK", "weather_variables": {"RHx": 2}},
        "Load": {"Preprocessor": {"fixes": ["zeros"]}},
    }
    results = {"testing_MAPE": 2.5, "training_time": 3.0}
    assert runs.append_run(spark, store, settings, results, "lr_benchmark") == 0
    assert runs.append_run(spark, store, settings, results, None) == 1
    out = runs.load_results(spark, store).collect()
    assert len(out) == 1
    row = out[0]
    assert (row["RUN_ID"], row["testing_MAPE"], row["location"], row["train_years"], row["test_years"]) == (0, 2.5, "UK", 6, 2)
    assert row["optimizer"] == '{"optimizer_name":"Adam","lr":0.1}'
    assert (row["model_summary"], row["layer_count"], row["hidden_neuron"], row["fixes"]) == ("CNN:2x8", 2, 8, ["zeros"])
    assert runs.load_results(spark, store, "other").count() == 0


def test_single_layer_has_no_hidden_mean(spark):
    df = spark.createDataFrame([('{"config":[{"class_name":"Dense","config":{"units":4}}]}',)], "arch string")
    row = runs.arch_details(df).first()
    assert row["hidden_neuron"] is None and row["average_neuron"] == 4.0


def test_levels_from_differences(spark):
    load = series(spark, [10, 12, 15, 11, 9, 20])
    diffs = features.difference(load.drop("idx")).drop("start")
    halves = diffs.withColumn("role", F.when(F.hour("Period") < 3, "train").otherwise("test"))
    scored = halves.withColumnRenamed("TS", "actual").withColumn("forecast", F.col("actual") + 1)
    out = evaluate.rebuild_levels(scored, load, ["series_id", "role"])
    assert column(out, "actual") == [12, 15, 11, 9, 20]
    assert column(out, "forecast") == [12, 16, 11, 10, 22]
