"""Folds as intervals over rows kept once, and linear models from sums per year."""

import io
from contextlib import redirect_stdout
from datetime import datetime
from threading import Barrier, Thread

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from gridseries.operators import features, forecast, linear, runs, scaling, splits
from gridseries.sources import sinks
from helpers import series

FEATURES = ["a", "b", "c"]


def plain_rows(per_year=40):
    rng = np.random.default_rng(2)
    out = []
    for name in ("x", "y", None):
        for year in (2001, 2002, 2004, 2005):
            for k in range(per_year):
                a, b, c = rng.normal(1000, 50), rng.normal(0, 1e-3), float(k % 7)
                noise = rng.normal()
                out.append((name, datetime(year, 1 + k % 12, 1 + k // 12), a, b, c, 5 + 2 * a - 300 * b + (3 if name else -1) * c + noise))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    schema = "series_id string, Period timestamp_ntz, a double, b double, c double, TS double"
    return spark.createDataFrame(plain_rows(), schema)


def solved(part, width=3):
    x = np.array([[1.0, *r[2 : 2 + width]] for r in part])
    return np.linalg.lstsq(x, np.array([r[5] for r in part]), rcond=None)[0]


def test_models_of_all_folds_equal_separate_fits(spark, rows):
    folds = splits.fold_rows(rows, (2, 1))
    models = {(r["series_id"], r["fold"]): r for r in linear.train(folds, FEATURES).collect()}
    assert len(models) == 6
    for (name, fold), model in models.items():
        years = [(2001, 2002), (2002, 2004)][fold]
        part = [r for r in plain_rows() if r[0] == name and r[1].year in years]
        want = solved(part)
        assert model["n"] == len(part)
        np.testing.assert_allclose([model["intercept"], *model["coefficients"]], want, rtol=1e-7, atol=1e-7)
        rest = np.array([r[5] for r in part]) - np.array([[1.0, *r[2:5]] for r in part]) @ want
        np.testing.assert_allclose(model["rmse"], np.sqrt((rest**2).mean()), rtol=1e-6)


def test_models_read_every_row_once(rows):
    products = linear.year_products(rows, FEATURES)
    with redirect_stdout(io.StringIO()) as plan:
        linear.fit_folds(products, splits.fold_years(rows, (2, 1)), FEATURES).explain("formatted")
    text = plan.getvalue()
    assert "partial_sum" in text  # sums combine before they are shuffled
    n = products.groupBy("series_id", "year").count().collect()
    assert {r["count"] for r in n} == {15} and len(n) == 12  # 5 * 6 / 2 sums for each series and year


def test_columns_that_others_determine(spark, rows):
    doubled = rows.withColumns({"d": F.col("a") * 2, "one": F.lit(7.0)})
    models = linear.train(splits.fold_rows(doubled, (2, 1)), ["a", "d", "one"])
    for r in models.collect():
        a, d, one = r["coefficients"]
        assert one == 0 and abs(a + 2 * d - 2) < 0.2 and np.isfinite(r["intercept"])


def test_incomplete_rows_are_an_error(rows):
    with pytest.raises(Exception, match="drop or fill incomplete rows"):
        linear.train(splits.fold_rows(rows.withColumn("a", F.when(F.col("c") > 0, F.col("a"))), (2, 1)), FEATURES).collect()


def test_predictions_follow_series_and_fold(rows):
    folds = splits.fold_rows(rows, (2, 1))
    out = linear.predict(folds.all(), linear.train(folds, FEATURES), FEATURES)
    assert out.count() == folds.all().count()
    assert out.agg(F.max(F.abs(F.col("forecast") - F.col("TS")))).first()[0] < 6


def test_rows_are_saved_once_and_a_fold_reads_its_years(spark, rows, tmp_path):
    folder = str(tmp_path / "saved")
    folds = splits.fold_rows(rows, (2, 1))
    scaler = scaling.fit_scaler(rows, ["TS"], "MinMaxScaler")
    sinks.save_dataset(folder, folds, scaler, {"k": 1})
    assert spark.read.parquet(f"{folder}/rows").count() == rows.count()
    again, _, settings = sinks.load_dataset(spark, folder)
    assert settings == {"k": 1} and again.numbers() == [0, 1]
    intervals = {(r["fold"], r["role"]): (r["first_year"], r["last_year"]) for r in again.intervals.filter("series_id = 'x'").collect()}
    assert intervals == {
        (0, "train"): (2001, 2002), (0, "test"): (2004, 2004), (1, "train"): (2002, 2004), (1, "test"): (2005, 2005)
    }

    def keyed(df):
        return sorted((str(r["series_id"]), r["Period"], r["TS"], r["fold"], r["role"]) for r in df.collect())

    assert keyed(again.all()) == keyed(splits.cv_splits(rows, (2, 1)))
    part = again.part(1, "test")
    assert keyed(part) == keyed(splits.cv_splits(rows, (2, 1)).filter("fold = 1 and role = 'test'"))
    with redirect_stdout(io.StringIO()) as plan:
        part.explain("formatted")
    filters = [line for line in plan.getvalue().splitlines() if line.startswith("PartitionFilters") and "fold_year" in line]
    assert len(filters) == 1 and "2005" in filters[0] and "2004" not in filters[0]


def test_scalers_per_fold_apply_when_rows_are_read(spark, rows, tmp_path):
    folds = splits.fold_rows(rows, (2, 1))
    params = scaling.fit_scaler(folds.part(role="train"), ["a", "TS"], "MinMaxScaler", ["series_id", "fold"])
    lazy = splits.Folds(folds.rows, folds.intervals, folds.by, params, ("a", "TS"), 32)
    sinks.save_dataset(str(tmp_path / "s"), lazy, params, {})
    again, _, _ = sinks.load_dataset(spark, str(tmp_path / "s"))
    ends = again.all().filter("role = 'train'").groupBy("series_id", "fold").agg(F.min("a"), F.max("a"), F.min("TS"), F.max("TS"))
    assert {tuple(r)[2:] for r in ends.collect()} == {(0.0, 1.0, 0.0, 1.0)}
    assert dict(again.all().dtypes)["a"] == "float"
    models = linear.train(again, FEATURES)
    out = linear.predict(again.all(), models, FEATURES)
    assert out.agg(F.max(F.abs(F.col("forecast") - F.col("TS")))).first()[0] < 0.1


def test_rows_without_a_period_are_in_no_fold(spark, rows):
    odd = rows.unionByName(rows.limit(3).withColumn("Period", F.lit(None).cast("timestamp_ntz")))
    assert splits.cv_splits(odd, (2, 1)).count() == splits.cv_splits(rows, (2, 1)).count()
    assert linear.train(splits.fold_rows(odd, (2, 1)), FEATURES).count() == 6


def test_any_model_feeds_back_step_by_step(spark):
    values = np.random.default_rng(0).normal(100, 10, 24 * 6)
    known = features.add_lags(series(spark, values), ["1r", "3r", "24r"], 1).na.drop().withColumn("fold", F.lit(0))
    known = known.withColumn("role", F.lit("train"))
    names = ["Previous_1", "Previous_3", "Previous_24"]
    model, _ = forecast.train_per_fold(known, LinearRegression(solver="normal"), names)[0]
    fitted = model.stages[-1]
    weights = {n: F.lit(float(w)) for n, w in zip(names, fitted.coefficients)} | {"intercept": F.lit(fitted.intercept)}
    want = forecast.predict_recurrent(known, weights, [1, 3, 24]).orderBy("Period").collect()
    got = forecast.predict_recurrent_by_step(known, model, [1, 3, 24]).orderBy("Period").collect()
    np.testing.assert_allclose([r["forecast"] for r in got], [r["forecast"] for r in want])
    tree, _ = forecast.train_per_fold(known, DecisionTreeRegressor(seed=1), names)[0]
    assert forecast.predict_recurrent_by_step(known, tree, [1, 3]).count() == len(want)


def test_two_writers_get_two_ids(spark, tmp_path):
    store, found, start = str(tmp_path / "store"), [], Barrier(4)

    def write(k):
        start.wait()
        found.append(runs.append_run(spark, store, {"k": k}, {"testing_MAPE": float(k)}, "f"))

    writers = [Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert len(found) == 4 and len(set(found)) == 4
    stored = runs.read_store(spark, store, "results", runs.RESULT_SCHEMA).collect()
    assert sorted(r["RUN_ID"] for r in stored) == sorted(found)
    assert sorted(r["testing_MAPE"] for r in stored) == [0.0, 1.0, 2.0, 3.0]
    assert runs.append_run(spark, store, {}, {}, "f") > max(found)
