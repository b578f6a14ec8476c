"""From files to forecasts and their errors, in a few calls."""

from __future__ import annotations

import dataclasses
import json
import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions.params import lag_rows
from gridseries.operators import (
    clustering,
    evaluate,
    features,
    forecast,
    linear,
    repair,
    runs,
    scaling,
    splits,
    stations,
    weather,
)
from gridseries.operators.timegrid import row_index
from gridseries.plans.settings import LOCATIONS, REGIONS, Settings
from gridseries.session import match, materialise, new_folder
from gridseries.sources import loader, sinks

KEYS = ["series_id", "Period"]
ROLES = ["fold", "role"]


class MissingDataError(Exception):
    """A step needs data that was not attached."""


class LoadForecaster:
    """Loads, cleans, trains and scores the forecast of one location."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, store: str | None = None):
        self.spark = spark
        self.settings = settings or Settings()
        self.store = store
        self.flag: str | None = None
        self.load: DataFrame | None = None
        self.weather: tuple[DataFrame, DataFrame] | None = None
        self.places: DataFrame | None = None
        self.stations_to_drop: DataFrame | None = None
        self.clean_load: DataFrame | None = None
        self.clean_weather: DataFrame | None = None
        self.data: splits.Folds | None = None
        self.scaler_y: DataFrame | None = None
        self.estimator: Estimator | None = None
        self.models: DataFrame | dict | None = None
        self.training_seconds = 0.0
        self.inference_seconds: dict[str, float] = {}

    # ---- settings

    def override(self, section: str, **values) -> LoadForecaster:
        self.settings.override(section, **values)
        return self

    @property
    def step(self) -> int:
        return LOCATIONS[self.settings.data.location][2]

    @property
    def per_hour(self) -> int:
        return 3600 // self.step

    # ---- data

    def attach_load(self, paths: str | Sequence[str], location: str, mode: str = "replace") -> None:
        """Register load files; attaching again replaces them, or adds to them with mode "append"."""
        if location not in LOCATIONS:
            raise ValueError(f"unknown location {location!r}; use one of {sorted(LOCATIONS)}")
        self.settings.data.location = location
        family = LOCATIONS[location][0]
        read = loader.read_ng_demand if family == "NG" else loader.read_ny_load
        self.load = loader.combine(self.load, read(self.spark, paths), mode)

    def attach_weather(
        self,
        stations_path: str,
        obs_paths: str | Sequence[str],
        variables: Sequence[str],
        stations_to_drop: Sequence[tuple[float, float]] = (),
        places: DataFrame | None = None,
    ) -> None:
        """Register the station list and observation files; `places` is a gazetteer, needed to keep regions."""
        variables = [v.strip() for v in variables]
        self.weather = (
            loader.read_stations(self.spark, stations_path),
            loader.read_weather(self.spark, obs_paths, variables, lineage=True),
        )
        self.places = places
        self.settings.data.weather_variables = {v: 0 for v in variables}
        if stations_to_drop:
            rows = [(float(a), float(b)) for a, b in stations_to_drop]
            self.stations_to_drop = self.spark.createDataFrame(rows, "LATITUDE double, LONGITUDE double")

    def prepare_load(self) -> DataFrame:
        """Standard series of the location, repaired."""
        if self.load is None:
            raise MissingDataError("no load data attached")
        location = self.settings.data.location
        family, target, _ = LOCATIONS[location]
        years = self.settings.data.year_range
        if family == "NG":
            dated = loader.parse_settlement_period(repair.fix_daylight(self.load))
        else:
            dated = loader.parse_time_stamp(self.load)
        named = dated.withColumn("series_id", F.lit(location))
        series = features.to_std_fields(named, target, years)
        if family == "NY":
            series = repair.merge_duplicates(repair.fill_null_zero(series))
        part = self.settings.load
        indexed = row_index(materialise(series, "load"))
        return repair.fix_data(indexed, part.fixes, part.max_error_width, part.threshold)

    def prepare_weather(self) -> DataFrame:
        """Cleaned weather of station clusters: one `<variable>_<cluster>` column each."""
        if self.weather is None:
            raise MissingDataError("no weather data attached")
        known, obs = self.weather
        part = self.settings.weather
        variables = list(self.settings.data.weather_variables)
        obs = obs.select("USAF", "Date", "HrMn", "ingest_ord", *variables)
        obs = repair.keep_first(weather.parse_date_hrmn(obs), ["USAF", "Period"], ["ingest_ord"]).drop("ingest_ord")
        if self.settings.data.year_range:
            obs = features.filter_years(obs, self.settings.data.year_range)
        obs = materialise(obs, "observations")
        known = stations.round_coords(stations.with_data(known, obs))
        regions = part.countries_to_keep or REGIONS.get(LOCATIONS[self.settings.data.location][1])
        known, obs = stations.filter_stations(
            known,
            obs,
            self.stations_to_drop,
            regions if self.places is not None else None,
            self.places,
            part.pre_clustering_data_quality,
        )
        if part.algorithm:
            known = clustering.clusterize(
                known, part.desired_cluster_count, part.min_cluster_size, part.algorithm, part.var
            )
        long = weather.preprocess(obs, known, variables)
        clean = materialise(
            weather.postprocess(materialise(long, "clusters"), self.step, part.post_clustering_data_quality), "weather"
        )
        return weather.pivot_clusters(clean, weather.cluster_names(clean))

    def process_data(self) -> None:
        """Clean load and weather, derive features, scale them, cut folds."""
        self.clean_load = materialise(self.prepare_load(), "clean-load")
        if self.weather is not None:
            self.clean_weather = materialise(self.prepare_weather(), "clean-weather")
        self.build_folds()

    def build_folds(self) -> None:
        """Features, scaling and folds from the cleaned data; needed again after their settings change."""
        if self.clean_load is None:
            raise MissingDataError("no cleaned load; call process_data first")
        part = self.settings.features
        data = self.clean_load.select(*KEYS, "idx", "TS")
        if part.load_difference:
            data = row_index(features.difference(data.drop("idx")).drop("start"))
        if self.clean_weather is not None:
            data = weather.join_weather(data, self.clean_weather)
        data = features.add_historical_ts(data, part.points, part.averages, self.per_hour).drop("idx")
        data = features.encode_time(data, part.time_encoding)
        data = materialise(data, "features")
        if part.time_encoding == "categorical":
            data = features.encode_vars(data)
        inputs = self.inputs(data)
        variables = self.settings.data.weather_variables
        self.settings.data.weather_variables = features.count_by_variable(inputs, list(variables))
        bits = self.settings.data.float_precision
        folds = splits.fold_rows(data, part.train_test)
        folds = dataclasses.replace(folds, intervals=materialise(folds.intervals, "folds"))
        if part.fit_on == "train":
            by, fitted = ["series_id", "fold"], folds.part(role="train")
        else:
            by, fitted = ["series_id"], data
        if part.stdz == "Normalizer":
            self.scaler_y = fitted.groupBy(*by).agg(F.lit(0.0).alias("TS__center"), F.lit(1.0).alias("TS__scale"))
        else:
            self.scaler_y = scaling.fit_scaler(fitted, ["TS"], part.stdz, by)
        self.scaler_y = materialise(self.scaler_y, "scaler-y")
        scalers = None
        if part.stdz == "Normalizer":
            data = scaling.normalize_rows(data, inputs)
        else:
            params = scaling.fit_scaler(fitted, inputs, part.stdz, by)
            if part.fit_on == "train":
                scalers = materialise(match(params, self.scaler_y, by), "scalers")
            else:
                data = scaling.scale(scaling.scale(data, params, inputs, by), self.scaler_y, ["TS"], by)
        if scalers is None:
            data = splits.cast_precision(data, [*inputs, "TS"], bits)
        rows = materialise(splits.with_year(data), "rows", [splits.YEAR])
        scaled = () if scalers is None else (*inputs, "TS")
        self.data = splits.Folds(rows, folds.intervals, folds.by, scalers, scaled, bits)

    @property
    def folds(self) -> DataFrame | None:
        """Every row once for each fold it takes part in, as models see it."""
        return None if self.data is None else self.data.all()

    def inputs(self, data: DataFrame | None = None) -> list[str]:
        """Names of the input columns."""
        return features.select_features(self.data.rows if data is None else data, ["TS"], [*KEYS, splits.YEAR])

    def train_shape(self, blocks: bool = True) -> tuple[int, ...]:
        """Shape of the first fold's training inputs: (blocks, steps, features), or (rows, features)."""
        first = self.data.part(0, "train")
        if not blocks:
            return first.count(), len(self.inputs())
        tensor = splits.block_tensor(first, self.inputs(), self.settings.data.forecast_horizon, self.per_hour)
        return splits.tensor_shape(tensor)

    # ---- models

    def train_model(self, estimator: Estimator | None = None) -> None:
        """Fit a fresh copy of any `pyspark.ml` regressor on the training years of every fold.

        Without one, linear models of all folds come from a single pass over the rows.
        """
        if self.data is None:
            raise MissingDataError("no folds; call process_data or load_data first")
        start = time.time()
        self.estimator = estimator
        if estimator is None:
            self.models = materialise(linear.train(self.data, self.inputs()), "models")
        else:
            self.models = forecast.train_per_fold(self.data, estimator, self.inputs())
        self.training_seconds = time.time() - start

    def predict_load(self, method: str = "direct", store: bool = False, training: bool = True) -> DataFrame:
        """Forecast all folds; returns a metric per fold and role.

        `training=False` leaves the training years out. "direct" scores each row from its features. "recurrent"
        works block by block and feeds forecasts back where the load would not be known yet.
        """
        if self.models is None:
            raise MissingDataError("no trained models; call train_model first")
        score = {"direct": self._direct, "recurrent": self._recurrent}[method]
        self.inference_seconds, scored = {}, None
        for role in ("train", "test") if training else ("test",):
            start = time.time()
            part = materialise(score(role), "scored")
            self.inference_seconds[role] = time.time() - start
            scored = part if scored is None else scored.unionByName(part)
        by = ["series_id", *(c for c in ["fold"] if c in self.scaler_y.columns)]
        actual = scaling.unscale(scored, self.scaler_y, ["TS"], by)
        both = scaling.unscale(actual, scaling.rename_params(self.scaler_y, "TS", "forecast"), ["forecast"], by)
        both = both.withColumnRenamed("TS", "actual")
        if self.settings.features.load_difference:
            both = evaluate.rebuild_levels(materialise(both, "differences"), self.clean_load, ["series_id", *ROLES])
        self.results = materialise(evaluate.point_errors(both), "results")
        part = self.settings.evaluation
        if store:
            self._store()
        return evaluate.get_measures(self.results, part.period, part.metric, ROLES)

    def _direct(self, role: str) -> DataFrame:
        if isinstance(self.models, dict):
            return forecast.predict_direct(self.data, self.models, [*KEYS, "TS"], role)
        scored = linear.predict(self.data.part(role=role), self.models, self.inputs())
        return scored.select(*KEYS, "TS", *ROLES, "forecast")

    def _recurrent(self, role: str) -> DataFrame:
        inputs = self.inputs()
        lags = [n for n in lag_rows(self.settings.features.points, self.per_hour) if f"Previous_{n}" in inputs]
        blocks = {"horizon": self.settings.data.forecast_horizon, "per_hour": self.per_hour, "by": ["series_id", *ROLES]}
        if isinstance(self.models, dict):
            parts = [
                forecast.predict_recurrent_by_step(self.data.part(fold, role), model, lags, **blocks)
                for fold, (model, _) in self.models.items()
            ]
            scored = reduce(DataFrame.unionByName, parts)
        else:
            rows = linear.with_models(self.data.part(role=role), self.models)
            scored = forecast.predict_recurrent(rows, linear.weights(inputs), lags, **blocks)
        return scored.select(*KEYS, "TS", *ROLES, "forecast")

    # ---- persistence

    def save_data(self, folder: str) -> None:
        """Write folds, target scaler and settings; refuses an existing folder."""
        if self.data is None:
            raise MissingDataError("no folds to save")
        sinks.save_dataset(folder, self.data, self.scaler_y, self.settings.as_dict())

    def load_data(self, folder: str) -> None:
        self.data, self.scaler_y, stored = sinks.load_dataset(self.spark, folder)
        self.settings = Settings.from_dict(stored)

    def _store(self) -> int:
        if self.store is None:
            self.store = new_folder(self.spark, "store")
        by_day = materialise(evaluate.fold_measures(self.results), "detailed-metrics")
        means = {
            f"{'training' if row['role'] == 'train' else 'testing'}_{name}": row[name]
            for row in by_day.groupBy("role").agg(*[F.avg(n).alias(n) for n in evaluate.STORED]).collect()
            for name in evaluate.STORED
        }
        folds = max(1, len(self.data.numbers()))
        seconds = {role: spent / folds for role, spent in self.inference_seconds.items()}
        unscored = {f"training_{name}": None for name in evaluate.STORED}
        results = unscored | means | {
            "training_time": self.training_seconds / folds,
            "mean_gpu_usage": None,
            "inference_time_train_set": seconds.get("train"),
            "inference_time_test_set": seconds.get("test"),
            "ran_epochs": None,
        }
        data, part = self.settings.data, self.settings.features
        name = type(self.estimator or LinearRegression()).__name__
        layer = {"class_name": name, "config": {"units": len(self.inputs())}}
        settings = {
            "Model": {"arch": json.dumps({"config": [layer]}), "backend": "spark", "optimizer": {"optimizer_name": name}},
            "ML_Preprocessor": {
                "time_encoding": part.time_encoding,
                "train_test": list(part.train_test),
                "stdz": part.stdz,
                "historical_ts": {"points": part.points, "averages": part.averages},
            },
            "Data": {
                "location": data.location,
                "forecast_horizon": data.forecast_horizon,
                "year_range": data.year_range,
                "weather_variables": data.weather_variables,
                "float_precision": data.float_precision,
            },
            "Load": {"Preprocessor": {"fixes": self.settings.load.fixes}},
        }
        details = {"detailed_results": self.results, "detailed_metrics": by_day}
        if not isinstance(self.models, dict):
            details["model_weights"] = self.models
        return runs.append_run(self.spark, self.store, settings, results, self.flag, details)

    def load_results(self, flag: str | None = None, detailed: bool = False) -> DataFrame:
        """Stored runs, a row each; `detailed` gives a row for each scored row of each run."""
        return runs.load_results(self.spark, self.store, flag, detailed)

    def load_details(self, table: str = "detailed_metrics", flag: str | None = None) -> DataFrame:
        """Metrics per fold and day of the year ("detailed_metrics") or "model_weights" of the stored runs."""
        return runs.load_details(self.spark, self.store, table, flag)


# ---- sweeps and dataset variants


def benchmark_variable(
    make: Callable[[], LoadForecaster],
    section: str,
    name: str,
    values: Sequence,
    run_count: int = 3,
    estimator: Estimator | None = None,
) -> str:
    """Train and score for every value of one setting, storing each run; returns the store's folder.

    The driver loops over values and repetitions; every fit and score is a
    distributed job. A setting repeats the cleaning it belongs to; features and
    folds are rebuilt for every value.
    """
    forecaster = make()
    forecaster.flag = f"{name}_benchmark"
    for value in values:
        forecaster.override(section, **{name: value})
        if section in ("load", "data"):
            forecaster.clean_load = materialise(forecaster.prepare_load(), "clean-load")
        if section in ("weather", "data") and forecaster.weather is not None:
            forecaster.clean_weather = materialise(forecaster.prepare_weather(), "clean-weather")
        if section != "evaluation":
            forecaster.build_folds()
        for _ in range(run_count):
            forecaster.train_model(estimator)
            forecaster.predict_load(store=True)
    return forecaster.store


def benchmark_datasets(
    spark: SparkSession,
    folders: Sequence[str],
    flag: str,
    store: str,
    estimator: Estimator | None = None,
    run_count: int = 3,
) -> str:
    """Train and score on every saved dataset, storing each run; returns the store's folder."""
    for folder in folders:
        forecaster = LoadForecaster(spark, store=store)
        forecaster.load_data(folder)
        forecaster.flag = f"{flag}_benchmark"
        for _ in range(run_count):
            forecaster.train_model(estimator)
            forecaster.predict_load(store=True)
    return store


def benchmark_models(
    make: Callable[[], LoadForecaster], estimators: Sequence[Estimator], run_count: int = 3
) -> str:
    """Train and score every estimator, storing each run; returns the store's folder."""
    forecaster = make()
    forecaster.flag = "models_benchmark"
    for estimator in estimators:
        for _ in range(run_count):
            forecaster.train_model(estimator)
            forecaster.predict_load(store=True)
    return forecaster.store


# The standard dataset variants, as overrides of the settings' sections. Variants with a "use" entry
# join the weather variables it lists.
ALL_WEATHER = ["W_Spd", "Air_Temp", "RHx"]
VARIANTS = {
    "base": {},
    "base_small": {"features": {"train_test": (2, 1)}, "data": {"year_range": [2008, 2009, 2010]}},
    "week_forecasting": {"data": {"forecast_horizon": "week"}},
    "no_weather_no_historical": {"features": {"points": [], "averages": []}},
    "no_weather_more_historical": {"features": {"points": ["1d", "2d", "7d"], "averages": ["1d", "2d", "7d"]}},
    "weather": {"use": ALL_WEATHER},
    "weather_categorical_time": {"use": ALL_WEATHER, "features": {"time_encoding": "categorical"}},
    "weather_basic_load_corrections": {"use": ALL_WEATHER, "load": {"fixes": ["zeros"]}},
    "weather_air_only": {"use": ["Air_Temp"]},
    "weather_wind_only": {"use": ["W_Spd"]},
    "weather_humidity_only": {"use": ["RHx"]},
    "weather_less_stations": {"use": ALL_WEATHER, "weather": {"desired_cluster_count": 3, "min_cluster_size": 3}},
    "weather_more_stations": {"use": ALL_WEATHER, "weather": {"desired_cluster_count": 40, "min_cluster_size": 2}},
}


def dataset_variants(
    forecaster: LoadForecaster, folder: str, variants: dict[str, dict] | None = None
) -> dict[str, str]:
    """Build and save a dataset per variant of the settings; returns variant -> folder.

    Cleaned load and weather are shared; a variant repeats only the cleaning
    whose settings it changes.
    """
    base = forecaster.settings.as_dict()
    cleaned = {}

    def shared(kind: str, settings: dict, prepare: Callable[[], DataFrame]) -> DataFrame:
        key = f"{kind} {json.dumps(settings, sort_keys=True)}"
        if key not in cleaned:
            cleaned[key] = materialise(prepare(), f"clean-{kind}")
        return cleaned[key]

    given = forecaster.clean_load
    saved = {}
    for name, overrides in (variants or VARIANTS).items():
        forecaster.settings = Settings.from_dict(base)
        for section, values in overrides.items():
            if section != "use":
                forecaster.override(section, **values)
        now = forecaster.settings.as_dict()
        changed = now["load"] != base["load"] or now["data"]["year_range"] != base["data"]["year_range"]
        if given is not None and not changed:
            forecaster.clean_load = given
        else:
            wanted = {"load": now["load"], "years": now["data"]["year_range"]}
            forecaster.clean_load = shared("load", wanted, forecaster.prepare_load)
        forecaster.settings.data.weather_variables = {v: 0 for v in overrides.get("use", [])}
        forecaster.clean_weather = None
        if "use" in overrides:
            wanted = {"weather": now["weather"], "years": now["data"]["year_range"], "use": overrides["use"]}
            forecaster.clean_weather = shared("weather", wanted, forecaster.prepare_weather)
        forecaster.build_folds()
        saved[name] = f"{folder}/{name}"
        forecaster.save_data(saved[name])
    forecaster.settings, forecaster.clean_load = Settings.from_dict(base), given
    return saved
