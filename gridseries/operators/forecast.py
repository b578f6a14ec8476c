"""Fitting and scoring forecasts: one line per series and fold, or any regressor per fold."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.operators.evaluate import METRICS, metric
from gridseries.operators.quantiles import attach
from gridseries.operators.splits import HORIZON_HOURS, Folds, complete_blocks
from gridseries.operators.timegrid import SERIES
from gridseries.session import match, materialise


def fit_line(df: DataFrame, x: str, y: str = "TS", by: Sequence[str] = (*SERIES, "fold")) -> DataFrame:
    """Least-squares line per series and fold, all of them in one aggregation."""
    train = df.filter(F.col("role") == "train") if "role" in df.columns else df
    return train.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n")
    )


def apply_line(df: DataFrame, lines: DataFrame, x: str, by: Sequence[str] = (*SERIES, "fold")) -> DataFrame:
    """Direct scoring: `forecast` from the line of the row's series and fold."""
    return (
        attach(df, lines.select(*by, "slope", "intercept"), by)
        .withColumn("forecast", F.col("intercept") + F.col("slope") * F.col(x))
        .drop("slope", "intercept")
    )


def _part(folds: DataFrame | Folds, fold: int, role: str | None = None) -> DataFrame:
    if isinstance(folds, Folds):
        return folds.part(fold, role)
    part = folds.filter(F.col("fold") == fold)
    return part if role is None else part.filter(F.col("role") == role)


def train_per_fold(
    folds: DataFrame | Folds,
    estimator: Estimator,
    features: Sequence[str],
    target: str = "TS",
) -> dict[int, tuple[Model, float]]:
    """A fresh fit of any `pyspark.ml` regressor per fold: fold -> (model, seconds).

    The driver loops over folds (a handful, bounded by the years of data); each
    fit is a distributed job. Linear models of all folds at once are in `linear`.
    Null or NaN features are an error: drop or fill incomplete rows before.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    estimator = estimator.copy({estimator.featuresCol: "features", estimator.labelCol: target})
    pipeline = Pipeline(stages=[assembler, estimator])
    if isinstance(folds, Folds):
        numbers = folds.numbers()
    else:
        numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    models = {}
    for fold in numbers:
        start = time.time()
        models[fold] = (pipeline.fit(_part(folds, fold, "train")), time.time() - start)
    return models


def predict_direct(
    folds: DataFrame | Folds, models: dict[int, tuple[Model, float]], keep: Sequence[str], role: str | None = None
) -> DataFrame:
    """Score every fold, or one role of it, with its own model; `forecast` is on the scale of the target."""
    scored = None
    for fold, (model, _) in models.items():
        part = model.transform(_part(folds, fold, role)).select(
            *keep, "fold", "role", F.col("prediction").alias("forecast")
        )
        scored = part if scored is None else scored.unionByName(part)
    return scored


def predict_recurrent(
    df: DataFrame,
    weights: dict[str, Column],
    lags: Sequence[int],
    horizon: str = "day",
    per_hour: int = 1,
    by: Sequence[str] = (*SERIES, "fold"),
    keep: Sequence[str] = ("TS",),
) -> DataFrame:
    """Score a linear model block by block, feeding forecasts back.

    Inside a block, the load p rows back is unknown from row p on and is
    replaced by the forecast made p rows earlier. `weights` maps "intercept" and
    feature names to columns of `df`. Rows are sequential within a block of one
    horizon; blocks are independent and spread over the cluster.
    """
    recurrent = {f"Previous_{p}": p for p in lags}
    fixed = weights.get("intercept", F.lit(0.0))
    for name, weight in weights.items():
        if name != "intercept" and name not in recurrent:
            fixed = fixed + weight * F.col(name)
    used = [p for name, p in recurrent.items() if name in weights]
    rows = complete_blocks(df, horizon, per_hour, by)
    step = F.struct(
        F.col("Period"),
        fixed.alias("fixed"),
        *[F.col(f"Previous_{p}").cast("double").alias(f"known_{p}") for p in used],
        *[weights[f"Previous_{p}"].cast("double").alias(f"weight_{p}") for p in used],
        *[F.col(k) for k in keep],
    )

    def forecast(done: Column, row: Column) -> Column:
        value = row["fixed"]
        for p in used:
            past = F.when(F.size(done) >= p, F.get(done, F.size(done) - p)).otherwise(row[f"known_{p}"])
            value = value + row[f"weight_{p}"] * past
        return F.concat(done, F.array(value))

    blocks = rows.groupBy(*by, "block").agg(F.array_sort(F.collect_list(step)).alias("_rows"))
    scored = blocks.withColumn("_forecasts", F.aggregate("_rows", F.array().cast("array<double>"), forecast))
    return scored.select(
        *by, "block", F.inline(F.arrays_zip(F.col("_rows").alias("row"), F.col("_forecasts").alias("forecast")))
    ).select(*by, "block", F.col("row.Period"), *[F.col(f"row.{k}") for k in keep], "forecast")


# Characters of a block's name that name the month, year or day it belongs to.
BLOCK_GROUP = {"hour": 10, "day": 7, "week": 4}


def predict_recurrent_with(
    df: DataFrame,
    predict: Callable[[pd.DataFrame], Sequence[float]],
    features: Sequence[str],
    lags: Sequence[int],
    horizon: str = "day",
    per_hour: int = 1,
    by: Sequence[str] = (*SERIES, "fold"),
) -> DataFrame:
    """The same with any model: `predict` takes a frame of features and returns a number per row.

    The complete blocks of a day, month or year (for hours, days, weeks) reach
    Python together and advance in step: one call of `predict` per place in the
    block, with one row per block.
    """
    rows = complete_blocks(df, horizon, per_hour, by).select(*by, "block", "Period", "TS", *features)
    rows = rows.withColumn("_group", F.substring("block", 1, BLOCK_GROUP[horizon]))
    feedback = [p for p in lags if f"Previous_{p}" in features]

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "Period"]).reset_index(drop=True)
        place = group.groupby("block").cumcount()
        done: list[np.ndarray] = []
        for i in range(int(place.max()) + 1):
            step = group.loc[place == i, list(features)].reset_index(drop=True)
            for p in feedback:
                if i >= p:
                    step[f"Previous_{p}"] = done[i - p]
            done.append(np.asarray(predict(step), float))
        forecasts = np.stack(done, axis=1).reshape(-1)
        return group.assign(forecast=forecasts)[[*by, "block", "Period", "TS", "forecast"]]

    keys = rows.select(*by, "block", "Period", "TS").schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.groupBy(*by, "_group").applyInPandas(score, f"{fields}, forecast double")


def predict_recurrent_by_step(
    df: DataFrame,
    model: Model,
    lags: Sequence[int],
    horizon: str = "day",
    per_hour: int = 1,
    by: Sequence[str] = (*SERIES, "fold"),
) -> DataFrame:
    """The same with any fitted `pyspark.ml` model.

    All blocks advance in step: the rows at one place of every block are scored
    together, with the forecasts of earlier places in the lags that reach them.
    The driver loops over the places of a block (its length, at most a week); each
    is one distributed job whose forecasts are written for the next ones. Lags that
    do not reach into a block cost nothing: then one job scores all rows.
    """
    by = list(by)
    keys = [*by, "block"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("Period")) - 1
    rows = complete_blocks(df, horizon, per_hour, by).withColumn("_place", place)
    inside = [p for p in lags if f"Previous_{p}" in df.columns and p < HORIZON_HOURS[horizon] * per_hour]
    keep = [*keys, "Period", "TS", "_place"]
    if not inside:
        return model.transform(rows).select(*keep, F.col("prediction").alias("forecast")).drop("_place")
    rows = materialise(rows, "steps", ["_place"])
    done: list[DataFrame] = []
    for i in range(HORIZON_HOURS[horizon] * per_hour):
        step = rows.filter(F.col("_place") == i)
        for p in inside:
            if p <= i:
                earlier = done[i - p].select(*keys, F.col("forecast").alias("_earlier"))
                step = match(step, earlier, keys).withColumn(f"Previous_{p}", F.col("_earlier")).drop("_earlier")
        scored = model.transform(step).select(*keep, F.col("prediction").alias("forecast"))
        done.append(materialise(scored, "step"))
    return reduce(DataFrame.unionByName, done).drop("_place")


def evaluate_folds(scored: DataFrame, names: Sequence[str] = tuple(METRICS), by: Sequence[str] = ()) -> DataFrame:
    """Metrics per fold and role of rows with `actual` and `forecast`."""
    return scored.groupBy(*by, "fold", "role").agg(*[metric(n).alias(n) for n in names])


def map_partitions(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """Apply a user function to batches of rows in parallel."""

    def each(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(each, schema)
