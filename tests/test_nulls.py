"""Null keys and null periods are rows like any other, whatever the number of groups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridseries.operators import clustering, features, forecast, quality, quantiles, repair, runs, scaling, timegrid
from gridseries.plans.settings import Settings
from gridseries.sources import loader

START = datetime(2021, 5, 1)
SCHEMA = "series_id string, Period timestamp_ntz, TS double"


def rows(*series):
    return [(s, START + timedelta(hours=k), float(k + 1)) for s in series for k in range(4)]


def of_null(df, *columns):
    return sorted(tuple(r) for r in df.filter("series_id is null").select(*columns).collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_does_not_depend_on_the_number_of_groups(spark, how):
    answers = []
    for series in ([None], [None, "a"]):
        df = spark.createDataFrame(rows(*series), SCHEMA)
        stats = df.groupBy("series_id").agg(F.max("TS").alias("top"))
        out = quantiles.attach(df, stats, ["series_id"], how)
        assert out.count() == df.count()
        answers.append(of_null(out, *out.columns))
    assert answers[0] == answers[1] and len(answers[0]) == 4


def test_scale_of_a_null_series(spark):
    answers = []
    for series in ([None], [None, "a"]):
        df = spark.createDataFrame(rows(*series), SCHEMA)
        params = scaling.fit_scaler(df, ["TS"], "MinMaxScaler", ["series_id"])
        out = scaling.scale(df, params, ["TS"], ["series_id"])
        answers.append(of_null(out, "Period", "TS"))
    assert answers[0] == answers[1] and [v for _, v in answers[0]] == [0.0, 1 / 3, 2 / 3, 1.0]


def test_row_order_keeps_null_periods_and_series(spark):
    data = rows("a", None) + [("a", None, 9.0), (None, None, 9.0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert timegrid.row_index(df).count() == len(data)
    assert timegrid.carry(df, F.col("TS")).count() == len(data)
    assert timegrid.running_sum(df, F.col("TS"), "total").count() == len(data)
    assert quality.gap_lengths(df, ["series_id"]).count() == len(data)
    assert repair.join_month_hour_mean(df).count() == len(data)
    placed = timegrid.row_index(df.filter("Period is not null"))
    assert [r[0] for r in of_null(placed, "idx")] == [0, 1, 2, 3]


def test_regrid_of_a_null_series(spark):
    df = spark.createDataFrame(rows(None, "a"), SCHEMA).filter("TS <> 2")
    out = timegrid.regrid(timegrid.row_index(df), 3600)
    assert [r[1] for r in of_null(out, "Period", "TS")] == [1.0, None, 3.0, 4.0]


def test_differences_of_a_null_series(spark):
    df = timegrid.row_index(spark.createDataFrame(rows(None, "a"), SCHEMA))
    assert features.difference(df).count() in (6, 8)
    assert len(of_null(features.difference(df), "Period")) * 2 == features.difference(df).count()


def test_mean_shift_that_does_not_settle_is_an_error(spark):
    stations = spark.createDataFrame([(str(i), 50 + i / 7, 1 + (i * i % 5) / 9) for i in range(12)], "USAF string, LATITUDE double, LONGITUDE double")
    with pytest.raises(RuntimeError, match="most_turns"):
        clustering.meanshift(stations, [0.5], most_turns=1)


def test_null_features_are_an_error(spark):
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(0, "train", 1.0, 2.0), (0, "train", None, 3.0)], "fold int, role string, x double, TS double")
    with pytest.raises(Exception, match="(?i)null"):
        forecast.train_per_fold(df, LinearRegression(), ["x"])


def test_store_of_another_kind_is_an_error(spark, tmp_path):
    assert runs.read_store(spark, str(tmp_path / "none"), "results", runs.RESULT_SCHEMA).count() == 0
    assert runs.append_run(spark, str(tmp_path / "store"), {}, {"testing_MAPE": 1.0}, "f") == 0
    assert runs.append_run(spark, str(tmp_path / "store"), {}, {"testing_MAPE": 1.0}, "f") == 1


def test_settings_without_quality_can_be_loaded():
    stored = Settings().override("weather", pre_clustering_data_quality=None).as_dict()
    assert Settings.from_dict(stored).weather.pre_clustering_data_quality is None


def test_csv_columns_by_name_in_every_file(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "a.csv").write_text("SETTLEMENT_DATE,SETTLEMENT_PERIOD,ND,ENGLAND_WALES_DEMAND\n01-JAN-2010,1,100,90\n")
    (folder / "b.csv").write_text("SETTLEMENT_DATE,SETTLEMENT_PERIOD,EXTRA,ND,ENGLAND_WALES_DEMAND\n02-JAN-2010,1,7,200,190\n")
    (folder / "c.csv").write_text("ENGLAND_WALES_DEMAND, ND ,SETTLEMENT_PERIOD,SETTLEMENT_DATE\n290,300,1,03-JAN-2010\n")
    out = loader.read_ng_demand(spark, str(folder), lineage=True)
    assert sorted((r.SETTLEMENT_DATE[:2], r.ND, r.ENGLAND_WALES_DEMAND) for r in out.collect()) == [
        ("01", 100.0, 90.0),
        ("02", 200.0, 190.0),
        ("03", 300.0, 290.0),
    ]
    (folder / "d.csv").write_text("SETTLEMENT_DATE,SETTLEMENT_PERIOD,ND\n04-JAN-2010,1,100\n")
    with pytest.raises(loader.FileLoadError, match="ENGLAND_WALES_DEMAND"):
        loader.read_ng_demand(spark, str(folder))
