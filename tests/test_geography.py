"""Clusters and nearest places against brute force in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridseries.operators import clustering, places, stations

RADIUS = 6371.0088


def frame(spark, points):
    rows = [(f"{i:06d}", float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "USAF string, LATITUDE double, LONGITUDE double")


def km(a, b):
    lat1, lon1, lat2, lon2 = map(np.radians, (*a, *b))
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.sqrt(min(1.0, h)))


def linked(points, reach):
    """Least index of each point's component in the graph of pairs within reach."""
    labels = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i in range(len(points)):
            for j in range(i):
                if labels[i] != labels[j] and km(points[i], points[j]) <= reach:
                    labels[i] = labels[j] = min(labels[i], labels[j])
                    changed = True
    return [f"{label:06d}" for label in labels]


def scattered(seed, n=60):
    rng = np.random.default_rng(seed)
    blobs = rng.normal([[52, 0]] * (n // 2), 0.3)
    wide = np.column_stack([rng.uniform(-89, 89, n // 4), rng.uniform(-180, 180, n // 4)])
    line = [[10.0, 179.0 + i * 0.2 if i * 0.2 < 1 else -181.0 + i * 0.2] for i in range(10)]
    poles = [[89.9, 10.0], [89.9, -170.0], [-89.95, 60.0]]
    return [tuple(np.round(p, 3)) for p in [*blobs, *wide, *line, *poles]] + [(52.0, 0.0)] * 4


def test_dbscan_equals_components(spark):
    points = scattered(1)
    reaches = [5.0, 25.0, 400.0]
    out = clustering.dbscan(frame(spark, points), reaches).collect()
    for reach in reaches:
        got = {r["USAF"]: r["label"] for r in out if r["var"] == reach}
        assert [got[f"{i:06d}"] for i in range(len(points))] == linked(points, reach)


def test_dbscan_does_not_depend_on_row_order(spark):
    df = frame(spark, scattered(2))
    one = clustering.dbscan(df, [30.0]).orderBy("USAF").collect()
    other = clustering.dbscan(df.orderBy(F.rand(3)), [30.0]).orderBy("USAF").collect()
    assert one == other


def test_crowded_cells_that_barely_touch(spark):
    """Two dense squares whose nearest corners decide; sample spots alone would not tell."""
    step = 0.002
    left = [(50 + i * step, 0 + j * step) for i in range(8) for j in range(8)]
    right = [(50 + i * step, 0.15 + j * step) for i in range(8) for j in range(8)]
    points = [tuple(np.round(p, 3)) for p in left + right]
    gap = min(km(a, b) for a in points[:64] for b in points[64:])
    out = clustering.dbscan(frame(spark, points), [gap * 0.9999, gap * 1.0001])
    counts = clustering.cluster_count(out).orderBy("var").collect()
    assert [r["clusters"] for r in counts] == [2, 1]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(
        F.lit(1.0).alias("var"), F.format_string("%04d", "id").alias("u"), F.format_string("%04d", F.col("id") + 1).alias("v")
    )
    out = clustering.components(edges)
    assert out.count() == 201
    assert out.select("root").distinct().collect()[0]["root"] == "0000"


def shifted_modes(points, bandwidth):
    """Flat-kernel mean shift, point by point."""
    points = np.array(points)
    found = {}
    for seed in points:
        at = seed
        for _ in range(300):
            near = points[np.linalg.norm(points - at, axis=1) <= bandwidth]
            new = np.round(near.mean(axis=0), 9)
            done = np.linalg.norm(new - at) <= 1e-3 * bandwidth
            at = new
            if done:
                break
        found[tuple(at)] = max(found.get(tuple(at), 0), len(near))
    kept = []
    for mode, n in sorted(found.items(), key=lambda kv: (kv[1], kv[0]), reverse=True):
        if all(np.linalg.norm(np.subtract(mode, k)) > bandwidth for k in kept):
            kept.append(mode)
    labels = []
    for p in points:
        away = [np.linalg.norm(p - k) for k in kept]
        labels.append(int(np.argmin(away)) if min(away) <= bandwidth else -1)
    return labels


@pytest.mark.parametrize("bandwidth", [0.4, 2.0])
def test_meanshift_equals_point_by_point(spark, bandwidth):
    rng = np.random.default_rng(7)
    points = [tuple(np.round(p, 3)) for p in rng.normal([[52, 0]] * 12 + [[54, 3]] * 10 + [[50, -4]] * 6, 0.5)]
    out = clustering.meanshift(frame(spark, points), [bandwidth]).collect()
    got = {r["USAF"]: r["label"] for r in out}
    assert [got[f"{i:06d}"] for i in range(len(points))] == shifted_modes(points, bandwidth)


def test_disc_sums_do_not_depend_on_levels(spark):
    rng = np.random.default_rng(8)
    points = rng.normal([[52, 0]] * 300, 0.8)
    spots = frame(spark, points).select(
        F.lit(1.1).alias("var"), "LATITUDE", "LONGITUDE", F.lit(1).cast("long").alias("weight")
    )
    seeds = spots.limit(20).select("var", F.col("LATITUDE").alias("seed_lat"), F.col("LONGITUDE").alias("seed_lon"))
    seeds = spark.createDataFrame(seeds.collect(), seeds.schema)
    want = {
        round(a, 9): int((np.linalg.norm(points - [a, b], axis=1) <= 1.1).sum())
        for _, a, b in [tuple(r) for r in seeds.collect()]
    }
    for levels in (1, 2, 3):
        out = clustering._disc_sums(seeds, spots, levels).collect()
        assert {round(r["seed_lat"], 9): r["n"] for r in out} == want


def test_clusterize_marks_one_centroid(spark):
    points = [(50.0, 0.0), (50.1, 0.0), (50.2, 0.0), (60.0, 5.0), (60.1, 5.0), (10.0, 10.0)]
    out = clustering.clusterize(frame(spark, points), min_size=2, algorithm="dbscan", var=20.0).orderBy("USAF").collect()
    assert [r["USAF"] for r in out] == [f"{i:06d}" for i in range(5)]
    assert [r["is_centroid"] for r in out] == [False, True, False, True, False]


def test_scan_takes_first_of_equal_candidates(spark):
    points = [(50.0, 0.0), (50.1, 0.0), (60.0, 5.0), (60.1, 5.0)]
    assert clustering.scan_bandwidth(frame(spark, points), 2, 2, "dbscan", [5.0, 20.0, 30.0]) == 20.0


def test_nearest_place_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    towns = [tuple(p) for p in np.round([*rng.normal([[52, 0]] * 40, 0.05), *scattered(4, 40)], 3)]
    rows = [(f"r{i}", i, float(a), float(b)) for i, (a, b) in enumerate(towns)]
    gazetteer = spark.createDataFrame(rows, "admin1 string, ord int, LATITUDE double, LONGITUDE double")
    points = scattered(5, 60)
    out = stations.nearest_place(frame(spark, points), gazetteer).collect()
    got = {r["USAF"]: (r["country"], r["km"]) for r in out}
    for i, p in enumerate(points):
        away = [km(p, t) for t in towns]
        region, far = got[f"{i:06d}"]
        assert abs(far - min(away)) < 1e-6
        assert abs(away[int(region[1:])] - min(away)) < 1e-6


def test_crowded_places_are_narrowed(spark):
    """Ten thousand places in one cube: a point meets a few of them, not all."""
    rng = np.random.default_rng(13)
    crowd = np.round(rng.normal([[52, 0]] * 10_000, 0.02), 5)
    rows = [(f"r{i}", i, float(a), float(b)) for i, (a, b) in enumerate(crowd)]
    gazetteer = spark.createDataFrame(rows, "admin1 string, ord int, LATITUDE double, LONGITUDE double")
    points = [tuple(map(float, p)) for p in np.round(rng.normal([[52, 0]] * 40, 0.03), 5)] + [(-52.0, 179.0), (90.0, 0.0)]
    pairs = stations._candidate_pairs(frame(spark, points), gazetteer, "admin1", "ord")
    assert pairs.count() < 42 * 400  # of 42 * 10,000
    got = {r["USAF"]: r["km"] for r in stations.nearest_place(frame(spark, points), gazetteer).collect()}
    for i, p in enumerate(points):
        assert abs(got[f"{i:06d}"] - min(km(p, t) for t in crowd)) < 1e-6


def test_no_places_and_no_points(spark):
    gazetteer = spark.createDataFrame([], "admin1 string, ord int, LATITUDE double, LONGITUDE double")
    out = stations.nearest_place(frame(spark, [(1.0, 2.0)]), gazetteer).first()
    assert out["country"] is None and out["km"] is None


def test_drop_by_coords_compares_pairs(spark):
    known = frame(spark, [(1.0, 2.0), (3.0, 4.0), (1.0, 4.0)])
    drop = spark.createDataFrame([(1.0, 2.0), (9.0, 9.0)], "LATITUDE double, LONGITUDE double")
    kept = stations.drop_by_coords(known, drop).orderBy("USAF").collect()
    assert [r["USAF"] for r in kept] == ["000001", "000002"]
    assert [tuple(r) for r in stations.coords_not_found(known, drop).collect()] == [(9.0, 9.0)]


def test_main_cities_once_per_name(spark):
    rows = [("A", "Admin-0 capital", 5), ("B", "Populated place", 9), ("C", "Populated place", 1), ("B", "Populated place", 7)]
    gazetteer = spark.createDataFrame(rows, "NAME string, FEATURECLA string, POP_MIN int")
    out = places.main_cities(gazetteer, 2).orderBy("NAME").collect()
    assert [(r["NAME"], r["POP_MIN"]) for r in out] == [("A", 5), ("B", 9)]


@pytest.mark.parametrize("reach", [5.0, 400.0, 30000.0])
def test_radius_neighbours_equal_brute_force(spark, monkeypatch, reach):
    for name, small in [("PLACE_POINTS", 2), ("PART_POINTS", 4), ("TASK_PAIRS", 64)]:
        monkeypatch.setattr(clustering, name, small)
    points = scattered(5)
    rows = [(f"{i:06d}", float(a), float(b)) for i, (a, b) in enumerate(points)]
    rows += [("000003", 52.0, 0.0), ("000003", 52.0, 0.0), ("nowhere", None, 0.0), (None, 52.0, 0.0)]
    df = spark.createDataFrame(rows, "USAF string, LATITUDE double, LONGITUDE double")
    known = sorted(r for r in rows if None not in r)
    expected = [(p[0], q[0], km(p[1:], q[1:])) for i, p in enumerate(known) for q in known[i + 1 :] if p[0] < q[0]]
    expected = sorted((a, b, round(d, 6)) for a, b, d in expected if d <= reach)
    out = clustering.radius_neighbours(df, reach).select("a", "b", F.round("km", 6).alias("km"))
    got = sorted(map(tuple, out.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in expected]
    assert np.allclose([r[2] for r in got], [r[2] for r in expected], atol=2e-6)


def test_radius_neighbours_of_crowded_places_are_shared_by_tasks(spark):
    n = 6000
    lat = F.when(F.col("id") % 3 == 0, 52.4).otherwise(52.0)
    df = spark.range(0, n, 1, 1).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("USAF"), lat.alias("LATITUDE"),
        F.lit(0.0).alias("LONGITUDE"))
    out = clustering.radius_neighbours(df, 75.0)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == n * (n - 1) // 2
    assert max(sizes) <= sum(sizes) / 2


def test_radius_neighbours_of_no_points(spark):
    assert clustering.radius_neighbours(frame(spark, scattered(5)).limit(0), 75.0).isEmpty()
