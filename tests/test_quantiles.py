import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.operators import quantiles, scaling

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize(
    "values",
    [
        [4.0],
        [4.0, 1.0],
        list(range(49)),
        [7.0] * 300 + [1.0, 2.0],
        list(np.random.default_rng(1).lognormal(size=3000)),
    ],
)
def test_exact_quantiles_equal_numpy(spark, values):
    df = frame(spark, {"a": values + [None], "b": [1.0, 2.0, 3.0]})
    out = quantiles.exact_quantiles(df, ["g"], {f"q{i}": ("v", q) for i, q in enumerate(PROBS)})
    got = {r["g"]: [r[f"q{i}"] for i in range(len(PROBS))] for r in out.collect()}
    np.testing.assert_allclose(got["a"], np.quantile(values, PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["b"], np.quantile([1, 2, 3], PROBS), rtol=1e-12)


def test_exact_quantiles_with_coarse_sketch(spark, monkeypatch):
    """A sketch too small for the data brackets ranks loosely; the result stays exact."""
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    values = list(np.random.default_rng(2).normal(size=20000))
    df = frame(spark, {"a": values}).repartition(6)
    out = quantiles.exact_quantiles(df, ["g"], {"low": ("v", 0.01), "mid": ("v", 0.5), "high": ("v", 0.99)}).first()
    np.testing.assert_allclose([out["low"], out["mid"], out["high"]], np.quantile(values, [0.01, 0.5, 0.99]), rtol=1e-12)


def test_without_groups(spark):
    df = frame(spark, {"a": range(10), "b": range(20)})
    out = quantiles.exact_quantiles(df, [], {"q": ("v", 0.5)}).first()
    assert out["q"] == np.quantile([*range(10), *range(20)], 0.5)


@pytest.mark.parametrize("points", [2, 11, 300])
def test_quantile_grid_equals_numpy(spark, points):
    values = [3.0] * 500 + list(np.random.default_rng(3).normal(size=1500))
    out = quantiles.quantile_grid(frame(spark, {"a": values}), "v", points, ["g"]).first()
    np.testing.assert_allclose(out["grid"], np.quantile(values, np.linspace(0, 1, points)), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("method", ["MinMaxScaler", "StandardScaler", "RobustScaler", "MaxAbsScaler", "QuantileTransformer"])
def test_unscale_undoes_scale(spark, method):
    values = np.random.default_rng(4).normal(50, 10, size=200)
    df = frame(spark, {"a": values, "b": values * 3})
    params = scaling.fit_scaler(df, ["v"], method, ["g"], points=100)
    there = scaling.scale(df.withColumn("was", F.col("v")), params, ["v"], ["g"], points=100)
    back = scaling.unscale(there, params, ["v"], ["g"], points=100)
    worst = back.agg(F.max(F.abs(F.col("v") - F.col("was")))).first()[0]
    assert worst < 1e-9


def test_quantile_scaler_puts_ties_half_way(spark):
    df = frame(spark, {"a": [0, 1, 1, 1, 2]})
    params = scaling.fit_scaler(df, ["v"], "QuantileTransformer", ["g"], points=5)
    out = scaling.scale(df, params, ["v"], ["g"], points=5)
    assert sorted(r["v"] for r in out.collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]


def test_constant_column_is_only_centred(spark):
    df = frame(spark, {"a": [5.0, 5.0]})
    params = scaling.fit_scaler(df, ["v"], "StandardScaler", ["g"])
    assert [r["v"] for r in scaling.scale(df, params, ["v"], ["g"]).collect()] == [0.0, 0.0]


def test_unknown_scaler(spark):
    with pytest.raises(ValueError):
        scaling.fit_scaler(frame(spark, {"a": [1]}), ["v"], "Other", ["g"])


@pytest.mark.parametrize("groups", [0, 1, 2])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_equals_a_join(spark, groups, how):
    rows = frame(spark, {"a": [1, 2], "b": [3], "c": [4]})
    stats = spark.createDataFrame([("a", 10.0, [1.0]), ("b", 20.0, [2.0])][:groups], "g string, s double, l array<double>")
    got = quantiles.attach(rows, stats, ["g"], how)
    want = rows.join(stats, "g", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rows", [1 << 16, 40])
def test_narrowed_brackets_give_the_same(spark, monkeypatch, rows):
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", rows)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.integers(0, 9, 500)])
    df = spark.createDataFrame([("a" if i % 3 else None, float(v)) for i, v in enumerate(values)], "s string, v double")
    wanted = {"q0": ("v", 0.0), "q1": ("v", 0.013), "q2": ("v", 0.5), "q3": ("v", 0.97), "q4": ("v", 1.0)}
    for by in (["s"], []):
        for row in quantiles.exact_quantiles(df, by, wanted).collect():
            mine = [v for i, v in enumerate(values) if not by or ("a" if i % 3 else None) == row["s"]]
            for name, (_, q) in wanted.items():
                assert row[name] == pytest.approx(np.quantile(mine, q), abs=1e-12)


def test_grids_of_all_columns_come_from_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(None if k % 3 else "a", float(a), int(b), None) for k, (a, b) in enumerate(zip(rng.normal(size=300), rng.integers(0, 4, 300)))]
    df = spark.createDataFrame(rows, "g string, x double, y int, z double")
    both = {r["g"]: r for r in scaling.fit_scaler(df, ["x", "y", "z"], "QuantileTransformer", ["g"], 50).collect()}
    assert set(both) == {None, "a"}
    for g, r in both.items():
        for i, c in ((1, "x"), (2, "y")):
            want = np.quantile([row[i] for row in rows if row[0] == g], np.linspace(0, 1, 50))
            np.testing.assert_allclose(r[f"{c}__grid"], want, atol=1e-12)
        assert r["z__grid"] is None
