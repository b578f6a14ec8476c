"""Files to metrics, with weather, on two months around New Year."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridseries.plans.forecaster import (
    LoadForecaster,
    MissingDataError,
    benchmark_datasets,
    benchmark_variable,
    dataset_variants,
)
from gridseries.plans.settings import Settings


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    rng = np.random.default_rng(0)
    times = pd.date_range("2007-12-01", "2008-01-31 23:00", freq="h")
    load = 5000 + 800 * np.sin(2 * np.pi * times.hour / 24) + 200 * (times.dayofweek < 5) + rng.normal(0, 30, len(times))
    load = np.round(np.asarray(load), 1)
    load[[100, 500, 501]] = 0
    pd.DataFrame({"Time Stamp": times.strftime("%m/%d/%Y %H:%M:%S"), "Integrated Load": load}).to_csv(
        folder / "ny.csv", index=False
    )
    places = {"700001": (40.6, -73.8), "700002": (40.7, -73.9), "700003": (43.0, -76.1), "700004": (43.1, -76.2)}
    (folder / "stations.txt").write_text(
        "USAF WBAN LATITUDE LONGITUDE\n" + "".join(f"{k}  1   {a} {b}\n" for k, (a, b) in places.items())
    )
    parts = []
    for k in places:
        temp = np.round(np.asarray(5 + 5 * np.sin(2 * np.pi * times.hour / 24) + rng.normal(0, 1, len(times))), 1)
        keep = rng.random(len(times)) > 0.02
        frame = pd.DataFrame(
            {"USAF": k, "Date": times.strftime("%Y%m%d"), "HrMn": (times.hour * 100).astype(str), "Air_Temp": temp}
        )
        parts.append(frame[keep])
    pd.concat(parts).to_csv(folder / "obs.csv", index=False)
    return folder


def forecaster(spark, files, weather=False):
    out = LoadForecaster(spark)
    out.attach_load(str(files / "ny.csv"), "NYC")
    out.override("features", train_test=(1, 1))
    if weather:
        out.attach_weather(str(files / "stations.txt"), str(files / "obs.csv"), ["Air_Temp"])
        out.override("weather", algorithm="dbscan", var=60.0, pre_clustering_data_quality=("1h", 85.0))
    return out


def test_steps_need_data(spark):
    empty = LoadForecaster(spark)
    for step in (empty.process_data, empty.train_model, empty.predict_load, empty.build_folds):
        with pytest.raises(MissingDataError):
            step()


@pytest.fixture(scope="module")
def processed(spark, files):
    out = forecaster(spark, files, weather=True)
    out.process_data()
    return out


def test_weather_columns_and_repairs(processed):
    assert {"Air_Temp_0", "Air_Temp_1", "Previous_24", "Previous_168", "Avg_1", "sin_hour"} <= set(processed.inputs())
    assert processed.settings.data.weather_variables == {"Air_Temp": 2}
    assert processed.clean_load.filter("zeros").count() == 3
    assert processed.clean_load.filter("TS = 0").count() == 0
    assert processed.clean_weather.filter("Air_Temp_0 is null or Air_Temp_1 is null").count() == 0
    assert processed.train_shape()[1:] == (24, len(processed.inputs()))


def test_direct_forecast_is_good_and_stored(processed, spark):
    processed.train_model()
    processed.flag = "demo"
    out = {r["role"]: r["MAPE"] for r in processed.predict_load(store=True).collect()}
    assert out["test"] < 3 and out["train"] < 2
    run = processed.load_results("demo").first()
    assert run["RUN_ID"] == 0 and run["location"] == "NYC" and run["testing_MAPE"] < 3
    assert run["weather_variables"] == '{"Air_Temp":2}'


def test_recurrent_equals_direct_when_all_lags_are_known(processed):
    """With lags of a day and more, a day block has nothing to feed back."""
    processed.train_model()
    processed.predict_load("direct")
    direct = processed.results.select("Period", "role", F.col("forecast").alias("d"))
    processed.predict_load("recurrent")
    both = processed.results.join(direct, ["Period", "role"])
    assert both.count() >= 24 * 50
    assert both.agg(F.max(F.abs(F.col("forecast") - F.col("d")))).first()[0] < 1e-6


def test_trees_feed_back_their_forecasts(processed):
    from pyspark.ml.regression import DecisionTreeRegressor

    processed.train_model(DecisionTreeRegressor(maxDepth=4, seed=1))
    direct = {r["role"]: r["MAPE"] for r in processed.predict_load("direct").collect()}
    recurrent = {r["role"]: r["MAPE"] for r in processed.predict_load("recurrent").collect()}
    assert set(recurrent) == {"train", "test"} and recurrent["test"] < direct["test"] + 2
    assert set(processed.inference_seconds) == {"train", "test"}


def test_runs_keep_metrics_times_and_weights(processed):
    processed.train_model()
    processed.flag = "kept"
    processed.predict_load(store=True)
    run = processed.load_results("kept").first()
    assert run["inference_time_train_set"] > 0 and run["inference_time_test_set"] > 0
    by_day = processed.load_details("detailed_metrics", "kept")
    mean = by_day.filter("role = 'test'").agg(F.avg("MAPE")).first()[0]
    assert abs(mean - run["testing_MAPE"]) < 1e-9
    assert {"fold", "role", "DoY", "MAPE", "RMSE", "RUN_ID"} == set(by_day.columns)
    assert len(processed.load_details("model_weights", "kept").first()["coefficients"]) == len(processed.inputs())
    assert processed.load_results("kept", detailed=True).count() == processed.results.count()


def test_save_and_load(processed, spark, tmp_path):
    folder = str(tmp_path / "saved")
    processed.save_data(folder)
    with pytest.raises(Exception):
        processed.save_data(folder)
    again = LoadForecaster(spark)
    again.load_data(folder)
    assert again.settings == processed.settings
    assert again.inputs() == processed.inputs()
    assert again.folds.count() == processed.folds.count()
    again.train_model()
    assert again.predict_load().filter("role = 'test'").first()["MAPE"] < 3


def test_categorical_time_and_train_only_scaling(spark, files):
    out = forecaster(spark, files)
    out.override("features", time_encoding="categorical", fit_on="train", stdz="MinMaxScaler", points=["7d"])
    out.process_data()
    assert "Hour_23" in out.inputs() and "Year" in out.inputs()
    top = out.folds.filter("role = 'train'").agg(F.max("TS"), F.min("TS")).first()
    assert tuple(top) == (1.0, 0.0)
    out.train_model()
    assert out.predict_load().filter("role = 'test'").first()["MAPE"] < 10


def test_benchmark_variable_stores_every_run(spark, files):
    made = forecaster(spark, files)

    def make():
        made.process_data()
        return made

    store = benchmark_variable(make, "features", "points", [["1d"], ["1d", "7d"]], run_count=1)
    out = made.load_results("points_benchmark").orderBy("RUN_ID").collect()
    assert made.store == store
    assert [r["RUN_ID"] for r in out] == [0, 1]
    assert [r["historical_ts"] for r in out] == [
        '{"points":["1d"],"averages":["1d","7d"]}', '{"points":["1d","7d"],"averages":["1d","7d"]}'
    ]


def test_dataset_variants_share_cleaning(spark, files, tmp_path):
    out = forecaster(spark, files, weather=True)
    variants = {
        "base": {},
        "weather": {"use": ["Air_Temp"]},
        "no history": {"features": {"points": [], "averages": []}},
        "zeros only": {"load": {"fixes": ["zeros"]}},
    }
    saved = dataset_variants(out, str(tmp_path), variants)
    widths = {}
    for name, folder in saved.items():
        again = LoadForecaster(spark)
        again.load_data(folder)
        widths[name] = len(again.inputs())
        assert again.folds.count() > 0
    assert widths["weather"] == widths["base"] + 2 and widths["no history"] == widths["base"] - 4
    store = benchmark_datasets(spark, [saved["base"], saved["weather"]], "data", str(tmp_path / "store"), run_count=1)
    again.store = store
    assert again.load_results("data_benchmark").count() == 2
    again.load_data(saved["zeros only"])
    assert again.settings.load.fixes == ["zeros"]


def test_unknown_setting_warns():
    with pytest.warns(UserWarning, match="nonsense"):
        Settings().override("features", nonsense=1)


def test_differenced_load_is_scored_as_load(spark, files):
    out = forecaster(spark, files)
    out.override("features", load_difference=True)
    out.process_data()
    out.train_model()
    assert [r["role"] for r in out.predict_load(training=False).collect()] == ["test"]
    load = out.clean_load.select("Period", "TS")
    both = out.results.join(load, "Period")
    assert both.agg(F.max(F.abs(F.col("actual") - F.col("TS")))).first()[0] < 1e-6
