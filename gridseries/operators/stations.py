"""Station dimension: which stations to keep, and where they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions import geo
from gridseries.operators import weather
from gridseries.session import materialise

# Cubes of the unit sphere in which places are looked up; each edge is a quarter of the one above.
TOP_EDGE = 2.0
DEEPEST = 12  # less than a metre
FEW_PLACES = 32
CUBE = ["kx", "ky", "kz"]
SPOT = ["LATITUDE", "LONGITUDE"]


def round_coords(stations: DataFrame, digits: int = 3) -> DataFrame:
    """Coordinates to `digits` decimals, half to even."""
    return stations.withColumns({c: F.bround(c, digits) for c in ("LATITUDE", "LONGITUDE")})


def with_data(stations: DataFrame, obs: DataFrame) -> DataFrame:
    """Stations that have observations."""
    return stations.join(obs.select("USAF").distinct(), "USAF", "left_semi")


def drop_by_coords(stations: DataFrame, coords: DataFrame) -> DataFrame:
    return stations.join(coords, ["LATITUDE", "LONGITUDE"], "left_anti")


def coords_not_found(stations: DataFrame, coords: DataFrame) -> DataFrame:
    return coords.join(stations, ["LATITUDE", "LONGITUDE"], "left_anti")


def keep_regions(stations: DataFrame, regions: Sequence[str], column: str = "country") -> DataFrame:
    return stations.filter(F.col(column).isin(list(regions)))


def _above(cube: str, levels: Column | int = 1) -> Column:
    """Number of the cube so many levels up that holds this one."""
    return F.floor(F.col(cube) / F.pow(F.lit(4), levels)).cast("long")


def _pyramid(towns: DataFrame) -> DataFrame:
    """(level, kx, ky, kz, n, sample, leaf): cubes of all levels that hold places, and how many.

    Built bottom-up in one pass: places combine into the smallest cubes, these count for every level above.
    A leaf holds few places and has no leaf above it; below a leaf there are no more cubes.
    """
    finest = TOP_EDGE / 4**DEEPEST
    smallest = towns.groupBy(*[F.floor(F.col(f"t{a}") / finest).cast("long").alias(f"k{a}") for a in "xyz"]).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("tx", "ty", "tz")).alias("sample")
    )
    every = smallest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))))
    every = every.withColumns({k: _above(k, DEEPEST - F.col("level")) for k in CUBE})
    cubes = every.groupBy("level", *CUBE).agg(F.sum("n").alias("n"), F.min("sample").alias("sample"))
    cubes = materialise(cubes, "pyramid")
    crowded = cubes.filter(F.col("n") > FEW_PLACES).select((F.col("level") + 1).alias("level"), *[F.col(k).alias(f"u{k}") for k in CUBE])
    reached = cubes.withColumns({f"u{k}": _above(k) for k in CUBE}).join(crowded, ["level", *[f"u{k}" for k in CUBE]], "left_semi")
    reached = cubes.filter("level = 0").unionByName(reached.select(*cubes.columns))
    return materialise(reached.withColumn("leaf", (F.col("n") <= FEW_PLACES) | (F.col("level") == DEEPEST)), "cubes")


def nearest_place(points: DataFrame, places: DataFrame, region: str = "admin1", tie: str = "ord") -> DataFrame:
    """Add the region (`country`) and distance (`km`) of the nearest place to each point.

    Coarse to fine: a point keeps a cube of places only while the cube could
    hold something nearer than the nearest sample place seen so far, and looks into smaller cubes
    until one holds few places; those are compared exactly. Neither crowded points (only
    distinct coordinates search) nor crowded places (whole cubes are dropped or
    narrowed) lead to all pairs.
    """
    answers = (
        _candidate_pairs(points, places, region, tie)
        .groupBy(*SPOT)
        .agg(F.min(F.struct("km", tie, F.col(region).alias("country"))).alias("_best"))
        .select(*SPOT, "_best.country", "_best.km")
    )
    return points.join(answers, SPOT, "left")


def _candidate_pairs(points: DataFrame, places: DataFrame, region: str, tie: str) -> DataFrame:
    """Distinct points beside every place that may be their nearest, with the distance."""
    known = places.filter(F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull())
    towns = known.groupBy(*SPOT).agg(F.min_by(F.struct(tie, region), tie).alias("_place"))
    vector = dict(zip("xyz", geo.unit_vector(*map(F.col, SPOT))))
    towns = towns.select(
        F.col("LATITUDE").alias("_lat"), F.col("LONGITUDE").alias("_lon"), "_place.*",
        *[c.alias(f"t{a}") for a, c in vector.items()],
    )
    towns = materialise(towns, "places")
    cubes = _pyramid(towns)
    leaves = cubes.filter("leaf").select("level", *CUBE)
    deepest = cubes.agg(F.max("level")).first()[0] or 0

    finest = TOP_EDGE / 4**DEEPEST
    at = {f"c{a}": F.floor(F.col(f"t{a}") / finest).cast("long") for a in "xyz"}
    homes = towns.withColumns(at).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    homes = homes.withColumns({f"k{a}": _above(f"c{a}", DEEPEST - F.col("level")) for a in "xyz"})
    homes = homes.join(leaves, ["level", *CUBE], "left_semi").select("level", *CUBE, "_lat", "_lon", tie, region)

    first = F.array(F.lit(-1), F.lit(0)).cast("array<long>")
    search = points.select(*SPOT).distinct().select(*SPOT, *[c.alias(f"p{a}") for a, c in vector.items()])
    search = search.withColumn("_best", F.lit(4.0))
    for k in CUBE:
        search = search.withColumn(f"u{k}", F.explode(first))
    kept = None
    for level in range(deepest + 1):
        edge = TOP_EDGE / 4**level
        here = cubes.filter(F.col("level") == level)
        up = {f"u{k}": _above(k, 1 if level else 0) for k in CUBE}
        near = search.join(here.withColumns(up), [f"u{k}" for k in CUBE])
        reach = F.sqrt(sum(((F.col(f"p{a}") - F.col(f"sample.t{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
        sides = {a: F.col(f"k{a}") * edge for a in "xyz"}
        outside = [
            F.greatest(sides[a] - F.col(f"p{a}"), F.col(f"p{a}") - (sides[a] + edge), F.lit(0.0)) for a in "xyz"
        ]
        gap = F.sqrt(sum((o * o for o in outside), F.lit(0.0)))
        best = F.min(F.least("_best", reach)).over(Window.partitionBy(*SPOT))
        near = near.withColumn("_best", best).filter(gap <= F.col("_best") + 1e-9)
        near = near.select(*SPOT, "px", "py", "pz", "_best", "level", *CUBE, "leaf")
        if level < deepest:
            near = materialise(near, "near")
        found = near.filter("leaf").select(*SPOT, "level", *CUBE)
        kept = found if kept is None else kept.unionByName(found)
        search = near.filter(~F.col("leaf")).drop("level", "leaf").withColumnsRenamed({k: f"u{k}" for k in CUBE})
    km = geo.haversine_km(F.col("LATITUDE"), F.col("LONGITUDE"), F.col("_lat"), F.col("_lon"))
    return kept.join(homes, ["level", *CUBE]).select(*SPOT, tie, region, km.alias("km"))


def filter_stations(
    stations: DataFrame,
    obs: DataFrame,
    coords_to_drop: DataFrame | None = None,
    regions: Sequence[str] | None = None,
    places: DataFrame | None = None,
    quality: tuple[str, float] | None = ("2h", 98.5),
) -> tuple[DataFrame, DataFrame]:
    """Stations and observations left after dropping by coordinates, region and availability."""
    if coords_to_drop is not None:
        stations = drop_by_coords(stations, coords_to_drop)
    if regions:
        if places is None:
            raise ValueError("keeping regions needs a table of places")
        stations = keep_regions(nearest_place(stations, places), regions).drop("km")
    if quality:
        good = materialise(weather.good_stations(obs, weather.seconds(quality[0]), quality[1]), "good-stations")
        stations = stations.join(good, "USAF", "left_semi")
        obs = obs.join(good, "USAF", "left_semi")
    return stations, obs
