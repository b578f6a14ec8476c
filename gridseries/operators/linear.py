"""Least squares for all series and folds from one pass over the data.

The sums of products of all features and the target are kept per (series, year).
They add up: the model of a sliding window of years is solved from the sum over
its years, so that no row is read or written once per fold. Sums are gathered in
numpy per batch, combined on the map side, then by Spark per (series, year, place in
the matrix); solving happens per (series, fold) in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.operators.quantiles import attach
from gridseries.operators.splits import Folds
from gridseries.operators.timegrid import SERIES
from gridseries.session import match

HELD_GROUPS = 1024
MODEL = "n long, intercept double, coefficients array<double>, rmse double"


def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def year_products(rows: DataFrame, features: Sequence[str], target: str = "TS", by: Sequence[str] = SERIES) -> DataFrame:
    """(series, year, place, value): upper triangle of the products of (1, features, target), summed per series and year.

    Rows without a Period belong to no year. A null or NaN feature or target is an error.
    """
    by, inputs = list(by), [*features, target]
    width = len(inputs) + 1
    upper = _places(width)
    keys = [F.col(c).cast("string").alias(f"_key{i}") for i, c in enumerate(by)]
    plain = rows.filter(F.col("Period").isNotNull()).select(
        *keys, F.year("Period").alias("year"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(inputs)]
    )
    key_names = [f"_key{i}" for i in range(len(by))]
    schema = ", ".join([*[f"{k} string" for k in key_names], "year int", "place int", "value double"])

    def records(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        groups = list(held)
        size = len(upper[0])
        columns = [pa.array(np.repeat(np.array([g[i] for g in groups], object), size), pa.string()) for i in range(len(by))]
        columns.append(pa.array(np.repeat(np.array([g[-1] for g in groups], np.int32), size)))
        columns.append(pa.array(np.tile(np.arange(size, dtype=np.int32), len(groups))))
        columns.append(pa.array(np.concatenate([held[g][upper] for g in groups])))
        return pa.RecordBatch.from_arrays(columns, [*key_names, "year", "place", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            values = [batch.column(f"_x{i}") for i in range(len(inputs))]
            matrix = np.column_stack([np.ones(batch.num_rows), *[v.to_numpy(zero_copy_only=False) for v in values]])
            if np.isnan(matrix).any():
                raise ValueError(f"null or NaN in {inputs}: drop or fill incomplete rows before fitting")
            frame = pa.Table.from_batches([batch.select([*key_names, "year"])]).to_pandas()
            for group, at in frame.groupby([*key_names, "year"], dropna=False, sort=False).indices.items():
                group = (*(None if isinstance(k, float) else k for k in group[:-1]), int(group[-1]))
                own = matrix[at]
                held[group] = held.get(group, 0.0) + own.T @ own
            if len(held) >= HELD_GROUPS:
                yield records(held)
                held = {}
        if held:
            yield records(held)

    sums = plain.mapInArrow(add, schema).groupBy(*key_names, "year", "place").agg(F.sum("value").alias("value"))
    types = dict(rows.dtypes)
    named = [F.col(k).cast(types[c]).alias(c) for k, c in zip(key_names, by, strict=True)]
    return sums.select(*named, "year", "place", "value")


def solve(products: np.ndarray, width: int) -> tuple[int, float, list[float], float]:
    """(n, intercept, coefficients, root mean squared error) from an upper triangle of summed products.

    Solved about the means, columns scaled to unit spread; a column that others
    determine takes the share of least size.
    """
    full = np.zeros((width, width))
    full[_places(width)] = products
    n = full[0, 0]
    means = full[0, 1:] / n
    spread = np.triu(full[1:, 1:])
    spread = spread + spread.T - np.diag(np.diag(spread)) - n * np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(spread), 0.0))
    flat = scale[:-1] <= 1e-9 * np.sqrt(n) * np.maximum(np.abs(means[:-1]), 1e-300)
    unit = np.where(flat, 1.0, scale[:-1])
    inner = np.where(flat[:, None] | flat[None, :], 0.0, spread[:-1, :-1] / np.outer(unit, unit))
    outer = np.where(flat, 0.0, spread[:-1, -1] / unit)
    weights = np.linalg.lstsq(inner, outer, rcond=1e-12)[0] / unit
    rest = spread[-1, -1] - 2 * weights @ spread[:-1, -1] + weights @ spread[:-1, :-1] @ weights
    return int(n), float(means[-1] - weights @ means[:-1]), weights.tolist(), float(np.sqrt(max(rest, 0.0) / n))


def fit_folds(products: DataFrame, years: DataFrame | None, features: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """(series, fold, n, intercept, coefficients, rmse) for the training years of every fold.

    `products` comes from `year_products`, `years` from `splits.fold_years`; without `years` the
    products are those of training rows and carry their fold.
    """
    by, width = list(by), len(features) + 2
    if years is not None:
        train = years.filter(F.col("role") == "train").select(*by, "year", "fold")
        products = match(products, train, [*by, "year"])
    summed = products.groupBy(*by, "fold", "place").agg(F.sum("value").alias("value"))
    # At most width * (width + 1) / 2 numbers per model.
    matrices = summed.groupBy(*by, "fold").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("m"))
    matrices = matrices.select(*by, "fold", F.col("m.value").alias("_products"))
    keys = [(f.name, f.dataType.simpleString()) for f in matrices.schema if f.name != "_products"]
    schema = ", ".join([*[f"`{name}` {kind}" for name, kind in keys], MODEL])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.float64()]
        names = ["n", "intercept", "coefficients", "rmse"]
        for batch in batches:
            solved = [solve(np.array(p), width) for p in batch.column("_products").to_pylist()]
            columns = list(zip(*solved, strict=True)) or [()] * 4
            own = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k, _ in keys), *own], [*(k for k, _ in keys), *names])

    return matrices.mapInArrow(each, schema)


def train(folds: Folds, features: Sequence[str], target: str = "TS") -> DataFrame:
    """One linear model per series and fold, all from one pass.

    Every row is read once, whatever the number of folds; only where scalers differ by
    fold is it read once per fold it is trained on.
    """
    by = list(folds.by)
    if folds.scalers is None:
        return fit_folds(year_products(folds.rows, features, target, by), folds.years(), features, by)
    scaled = folds.part(role="train")
    return fit_folds(year_products(scaled, features, target, [*by, "fold"]), None, features, by)


def weights(features: Sequence[str]) -> dict[str, Column]:
    """The attached model's numbers by feature name, as `forecast.predict_recurrent` takes them."""
    return {"intercept": F.col("intercept")} | {f: F.get("coefficients", F.lit(i)) for i, f in enumerate(features)}


def with_models(folds: DataFrame, models: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows beside `intercept` and `coefficients` of their series and fold."""
    return attach(folds, models.select(*by, "fold", "intercept", "coefficients"), [*by, "fold"])


def predict(folds: DataFrame, models: DataFrame, features: Sequence[str], by: Sequence[str] = SERIES) -> DataFrame:
    """Direct scoring: adds `forecast` from the model of the row's series and fold."""
    value = F.col("intercept")
    for name, weight in weights(features).items():
        if name != "intercept":
            value = value + weight * F.col(name)
    return with_models(folds, models, by).withColumn("forecast", value).drop("intercept", "coefficients")
