"""Resampling on events, availability from summaries, user metrics from sums, many clustering candidates at once."""

import io
import math
from contextlib import redirect_stdout
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.operators import clustering, evaluate, quality, weather
from gridseries.operators.repair import interpolate_limited
from gridseries.operators.timegrid import regrid, spine
from test_geography import frame, km

BY = weather.CLUSTER_SERIES
START = datetime(2020, 2, 27, 3, 35)


def readings(spark):
    rng = np.random.default_rng(11)
    rows = []
    for var, cluster in (("a", 0), ("a", 1), ("b", 0)):
        at = START + timedelta(minutes=int(rng.integers(0, 300)))
        for _ in range(150):
            # Mostly on the 5-minute grid, sometimes beside it, with gaps within and beyond the limit.
            at += timedelta(minutes=float(rng.choice([5, 20, 55, 60, 60, 240, 245, 700, 3])))
            rows.append((var, cluster, at, None if rng.random() < 0.1 else float(rng.normal())))
    rows.append(("c", 5, START, None))
    return spark.createDataFrame(rows, "var string, cluster_num int, Period timestamp_ntz, TS double")


@pytest.mark.parametrize("step,limit", [(3600, 48), (1800, 12), (86400, 48)])
def test_resampling_equals_the_fine_grid(spark, step, limit):
    long = readings(spark)
    fine = interpolate_limited(regrid(long, 300, BY, common_span=True), limit, BY)
    want = sorted(map(tuple, regrid(fine, step, BY, common_span=True).select(*BY, "Period", "idx", "TS").collect()), key=str)
    got = sorted(map(tuple, weather.resample(long, step, 300, limit).select(*BY, "Period", "idx", "TS").collect()), key=str)
    assert got == want and any(r[-1] is not None for r in got)


def test_resampling_makes_coarse_slots_only(spark, monkeypatch):
    asked = []

    def noted(span, step, by):
        asked.append(step)
        return spine(span, step, by)

    monkeypatch.setattr(weather, "spine", noted)
    day = weather.resample(readings(spark), 86400)
    assert asked == [86400] and day.count() == 4 * day.select("Period").distinct().count()


def test_resampling_nothing(spark):
    assert weather.resample(readings(spark).limit(0), 3600).count() == 0


def test_availability_across_buckets_of_time(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for name in ("x", "y", None):
        at, times = datetime(2019, 11, 1), []
        for _ in range(400):
            at += timedelta(hours=int(rng.choice([1, 1, 2, 3, 40, 24 * 35])))
            times.append(at)
        rows += [(name, t) for t in times]
        good = sum((b - a) <= timedelta(hours=2) for a, b in zip(times, times[1:]))
        want[name] = good * 100.0 / len(times)
    out = quality.availability(spark.createDataFrame(rows, "USAF string, Period timestamp_ntz").repartition(5), 7200)
    assert {r["USAF"]: r["availability"] for r in out.collect()} == pytest.approx(want)


def test_availability_shuffles_the_readings_once(spark):
    rows = spark.range(100).select(F.lit("a").alias("USAF"), F.lit(START).cast("timestamp_ntz").alias("Period"))
    with redirect_stdout(io.StringIO()) as plan:
        quality.availability(rows, 60).explain()
    text = plan.getvalue()
    assert "Join" not in text and text.count("hashpartitioning(USAF") <= 3


def test_user_metric_equals_python(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 5 == 0 else f"g{k % 5}", k % 3, float(a), float(b)) for k, (a, b) in enumerate(rng.normal(10, 2, (3000, 2)))]
    df = spark.createDataFrame(rows, "name string, part int, actual double, forecast double").repartition(7)

    def partial(actual, predicted):
        return len(actual), (actual - predicted).sum(), ((actual - predicted) ** 2).sum()

    def spread(s):
        return math.sqrt(s[2] / s[0] - (s[1] / s[0]) ** 2)

    out = evaluate.group_metric(df, ["name", "part"], ["actual", "forecast"], partial, spread, "spread").collect()
    assert len(out) == 15
    for r in out:
        own = np.array([x[2] - x[3] for x in rows if x[0] == r["name"] and x[1] == r["part"]])
        assert r["spread"] == pytest.approx(own.std())
    assert evaluate.group_metric(df.limit(0), ["name"], ["actual"], lambda a: [a.sum()], lambda s: s[0]).count() == 0


def labels_of(points, reach):
    parent = list(range(len(points)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if km(points[i], points[j]) <= reach:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {f"{i:06d}": f"{find(i):06d}" for i in range(len(points))}


def test_many_candidates_are_cuts_of_one_forest(spark):
    rng = np.random.default_rng(12)
    towns = rng.normal([[52, 0]] * 25, 0.05)  # a crowd within a few km
    wide = np.column_stack([rng.uniform(-70, 70, 15), rng.uniform(-180, 180, 15)])
    line = [(60 + 0.01 * k * k, 179.9 + 0.02 * k) for k in range(12)]  # growing steps over the date line
    points = [tuple(map(float, np.round(p, 3))) for p in [*towns, *rng.normal([[50, 2]] * 15, 1.0), *wide, *line]]
    points += points[:3]
    points = [(a, b if b <= 180 else b - 360) for a, b in points]
    reaches = [float(r) for r in np.round(np.geomspace(0.5, 1500, 40), 4)]
    found = {}
    for r in clustering.dbscan(frame(spark, points), reaches).collect():
        found.setdefault(r["var"], {})[r["USAF"]] = r["label"]
    assert set(found) == set(reaches)
    for reach in reaches:
        assert found[reach] == labels_of(points, reach), reach


def test_scales_cover_all_reaches():
    reaches = [1.0, 1.5, 2.0, 2.1, 10.0, 150.0]
    assert clustering._scales(reaches) == [(0, 2), (3, 3), (4, 4), (5, 5)]
