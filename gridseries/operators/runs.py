"""Experiment runs: storing, reading back, flattening and comparing them."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.operators.evaluate import box_stats

ARCH_SCHEMA = "struct<config: array<struct<class_name: string, config: struct<units: int, filters: int>>>>"

RESULT_SCHEMA = """RUN_ID long, flag string, training_MAPE double, training_RMSE double, testing_MAPE double,
    testing_RMSE double, training_time double, mean_gpu_usage double, inference_time_train_set double,
    inference_time_test_set double, ran_epochs double"""
SETTINGS_SCHEMA = "RUN_ID long, flag string, settings string"
CLAIM_SCHEMA = "RUN_ID long, writer string"

# Parts of the stored settings reports use; other members stay in the text.
SETTINGS_STRUCT = """struct<
    Model: struct<arch: string, batch_size: int, epochs: int, backend: string,
        optimizer: struct<optimizer_name: string, lr: double, decay: double, momentum: double, nesterov: boolean>>,
    ML_Preprocessor: struct<time_encoding: string, train_test: array<int>, stdz: string,
        historical_ts: struct<points: array<string>, averages: array<string>>>,
    Data: struct<location: string, forecast_horizon: string, year_range: array<int>, data_shape_mode: string,
        weather_variables: map<string, int>, float_precision: int>,
    Load: struct<Preprocessor: struct<fixes: array<string>>>>"""


# ---- store


def read_store(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    """A table of the store; one that was never written is empty."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{store}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in _fields(spark, schema)]
        )


def _fields(spark: SparkSession, schema: str):
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("s")).select("s.*").schema.fields


def last_run_id(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("RUN_ID").alias("RUN_ID"))


def next_run_id(runs: DataFrame) -> DataFrame:
    """One above the highest id, 0 when there are no runs."""
    return last_run_id(runs).select((F.coalesce("RUN_ID", F.lit(-1)) + 1).alias("RUN_ID"))


def with_next_run(runs: DataFrame, new: DataFrame) -> DataFrame:
    """The runs with one more row, whose id follows the highest one."""
    numbered = new.drop("RUN_ID").withColumn("RUN_ID", next_run_id(runs).scalar())
    return runs.unionByName(numbered, allowMissingColumns=True)


def claim_run_id(spark: SparkSession, store: str) -> int:
    """An id that no other writer of the store has or will get, one above the highest where nobody else writes.

    Every writer first leaves a claim for the id in a folder of its own, then
    looks whether it is the only one. Of two writers the one that looks later
    sees both claims, so at most one of them keeps the id; who sees another goes on to a higher one.
    """
    token = uuid.uuid4().hex
    results = read_store(spark, store, "results", RESULT_SCHEMA)
    claims = read_store(spark, store, "claims", CLAIM_SCHEMA)
    run_id = next_run_id(results.select("RUN_ID").unionByName(claims.select("RUN_ID"))).first()["RUN_ID"]
    while True:
        mine = spark.createDataFrame([(run_id, token)], CLAIM_SCHEMA).coalesce(1)
        mine.write.mode("errorifexists").parquet(f"{store}/claims/run-{run_id}-{token}")
        if read_store(spark, store, "claims", CLAIM_SCHEMA).filter(F.col("RUN_ID") == run_id).count() == 1:
            return run_id
        run_id += random.randint(1, 4)


def append_run(
    spark: SparkSession,
    store: str,
    settings: dict,
    results: dict,
    flag: str | None,
    details: dict[str, DataFrame] | None = None,
) -> int:
    """Store one run and return its id. `details` are extra tables, written with id and flag.

    Every run has a folder of its own in each table, so that writers never meet.
    """
    run_id = claim_run_id(spark, store)

    def put(rows: DataFrame, table: str) -> None:
        rows.write.mode("errorifexists").parquet(f"{store}/{table}/run-{run_id}")

    for name, table in (details or {}).items():
        put(table.withColumns({"RUN_ID": F.lit(run_id).cast("long"), "flag": F.lit(flag).cast("string")}), name)
    text = {"RUN_ID": run_id, "flag": flag, "settings": json.dumps(settings)}
    put(spark.createDataFrame([text], SETTINGS_SCHEMA).coalesce(1), "settings")
    row = {"RUN_ID": run_id, "flag": flag} | results
    put(spark.createDataFrame([row], RESULT_SCHEMA).coalesce(1), "results")
    return run_id


def scan_runs(runs: DataFrame, flag: str | None = None) -> DataFrame:
    """Runs with this flag, or all that have one."""
    return runs.filter(F.col("flag") == flag if flag else F.col("flag").isNotNull())


def join_run_tables(results: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables side by side by RUN_ID, keeping runs that only some of them know."""
    for other in others:
        results = results.join(other, "RUN_ID", "full")
    return results


def load_results(spark: SparkSession, store: str, flag: str | None = None, detailed: bool = False) -> DataFrame:
    """Stored runs, one row each, with settings and architecture as columns."""
    results = scan_runs(read_store(spark, store, "results", RESULT_SCHEMA), flag).drop("flag")
    settings = scan_runs(read_store(spark, store, "settings", SETTINGS_SCHEMA), flag)
    parsed = settings.withColumn("settings", F.from_json("settings", SETTINGS_STRUCT))
    flat = expand_struct(join_run_tables(results, parsed), "settings")
    for part in ("Model", "ML_Preprocessor", "Data"):
        flat = expand_struct(flat, part)
    flat = (
        arch_details(flat, "arch")
        .withColumn("fixes", F.col("Load.Preprocessor.fixes"))
        .withColumn("weather_variables", F.to_json("weather_variables"))
        .withColumn("historical_ts", F.to_json("historical_ts"))
    )
    flat = split_optimizer(split_train_test(flat)).drop("arch", "Load")
    if detailed:
        flat = join_run_tables(flat, load_details(spark, store, "detailed_results", flag))
    return flat


def load_details(spark: SparkSession, store: str, table: str = "detailed_metrics", flag: str | None = None) -> DataFrame:
    """An extra table of the stored runs, by RUN_ID."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{store}/{table}")
    return scan_runs(rows, flag).drop("flag")


# ---- flattening


def expand_struct(df: DataFrame, column: str) -> DataFrame:
    """The members of a struct column as columns in its place."""
    return df.select("*", f"{column}.*").drop(column)


def split_train_test(df: DataFrame) -> DataFrame:
    return df.withColumn("train_years", F.element_at("train_test", 1)).withColumn(
        "test_years", F.element_at("train_test", 2)
    )


def split_optimizer(df: DataFrame) -> DataFrame:
    """Name and learning rate as columns, the optimizer itself as text without empty members."""
    return (
        df.withColumn("lr", F.col("optimizer.lr"))
        .withColumn("name", F.col("optimizer.optimizer_name"))
        .withColumn("optimizer", F.to_json("optimizer"))
    )


def layer_units(arch: Column) -> Column:
    """Per layer its filters if it has any, else its units."""
    return F.transform(arch["config"], lambda y: F.coalesce(y["config"]["filters"], y["config"]["units"]))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values))


def arch_details(df: DataFrame, column: str = "arch") -> DataFrame:
    """Layer types and sizes, counts and short names from an architecture's JSON text."""
    arch = F.from_json(column, ARCH_SCHEMA)
    out = df.withColumn("layer_type", F.transform(arch["config"], lambda y: y["class_name"])).withColumn(
        "layer_config", layer_units(arch)
    )
    sizes = F.col("layer_config")
    hidden = F.slice(sizes, F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(0)))
    return out.withColumns(
        {
            "average_neuron": array_mean(sizes),
            "layer_count": F.size(sizes),
            "neuron_count": array_sum(sizes).cast("long"),
            "hidden_neuron": array_mean(hidden).cast("int"),
            "model": F.zip_with("layer_type", sizes, lambda t, n: F.concat_ws(":", t, n.cast("string"))),
            "model_type": F.get("layer_type", F.lit(0)),
            "model_summary": F.concat(
                F.get("layer_type", F.lit(0)), F.lit(":"), F.size(sizes), F.lit("x"), F.get(sizes, F.lit(0))
            ),
        }
    )


def strip_backend_prefix(model_type: Column) -> Column:
    return F.regexp_replace(model_type, "^CuDNN", "")


# ---- reports


def sweep_means(
    runs: DataFrame,
    var: str,
    measures: Sequence[str] = ("testing_MAPE", "training_MAPE", "training_time"),
    merge_models: bool = True,
) -> DataFrame:
    """Mean measures per value of the swept variable, within location and model type."""
    model = strip_backend_prefix(F.col("model_type")) if merge_models else F.col("model_type")
    return runs.groupBy("location", model.alias("model_type"), var).agg(*[F.avg(m).alias(m) for m in measures])


def _of_model(runs: DataFrame, merge_models: bool) -> DataFrame:
    return runs.withColumn("model_type", strip_backend_prefix(F.col("model_type"))) if merge_models else runs


def sweep_box(runs: DataFrame, var: str, measure: str = "testing_MAPE", merge_models: bool = True) -> DataFrame:
    """Box statistics of a measure per value of the swept variable, within location and model type."""
    return box_stats(_of_model(runs, merge_models), measure, ["location", "model_type", var])


def sweep_table(
    runs: DataFrame,
    var: str,
    measures: Sequence[str] = ("testing_MAPE", "training_MAPE", "training_time"),
    merge_models: bool = True,
) -> DataFrame:
    """Number of runs and mean, least and greatest of each measure per swept value, location and model type."""
    parts = [f(m).alias(f"{name}_{m}") for m in measures for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    rows = _of_model(runs, merge_models)
    return rows.groupBy("location", "model_type", var).agg(F.count(F.lit(1)).alias("runs"), *parts)


def sweep_pivot(runs: DataFrame, rows: str, columns: str, values: Sequence, measure: str = "testing_MAPE") -> DataFrame:
    """Mean measure by two factors; the listed values of the second become columns."""
    wide = runs.groupBy(rows).pivot(columns, list(values)).agg(F.avg(measure))
    return wide.withColumnsRenamed({str(v): f"{columns}_{v}" for v in values})


def rank_models(runs: DataFrame, location: str, model: str = "model_type") -> DataFrame:
    """Mean measures per model at one location, best first."""
    measures = ("testing_MAPE", "training_MAPE", "training_time")
    here = runs.filter(F.col("location") == location).groupBy("location", model)
    return here.agg(*[F.avg(m).alias(m) for m in measures]).orderBy("testing_MAPE", model)


def backend_means(runs: DataFrame) -> DataFrame:
    return runs.groupBy(strip_backend_prefix(F.col("model_type")).alias("model_type"), "backend").agg(
        F.avg("training_time").alias("training_time"), F.avg("testing_MAPE").alias("testing_MAPE")
    )


# ---- sweeps


def param_grid(base: DataFrame, **lists: Sequence) -> DataFrame:
    """Every combination of the listed parameter values, for each row of `base`."""
    for name, values in lists.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base


def sweep(values: Sequence, run_count: int, job: Callable[[object], DataFrame]) -> DataFrame:
    """The results of `job` for every value and repetition, as one plan."""
    out = None
    for value in values:
        for repetition in range(run_count):
            part = job(value).withColumn("value", F.lit(value)).withColumn("repetition", F.lit(repetition))
            out = part if out is None else out.unionByName(part)
    return out
