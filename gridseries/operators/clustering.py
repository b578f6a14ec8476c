"""Station clustering: DBSCAN by great-circle distance, mean shift in degrees.

Both run for several candidate parameters at once: DBSCAN cuts one forest, and the
tables of mean shift are keyed by `var`, the candidate. Loops run on the driver, each round is one
distributed job whose result is written to the shared folder.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions import geo
from gridseries.functions.params import spaced
from gridseries.functions.search import count_below
from gridseries.operators.quantiles import attach
from gridseries.operators.timegrid import row_index
from gridseries.session import materialise

# Candidate ranges (start, stop, count) when no parameter is given; km and degrees.
VAR_RANGES = {"dbscan": (1, 150, 500), "meanshift": (0.025, 5, 300)}

MAX_SHIFTS = 300
SPOT = ["LATITUDE", "LONGITUDE"]


# ---- neighbours within a radius


PLACE_POINTS = 128  # of one place that stay together
PART_POINTS = 512  # of one cube, about
TASK_PAIRS = 1 << 22


def _parts(points: DataFrame, edge: Column, key: str) -> DataFrame:
    """(x, y, z, part, n, places): the points of a cube in parts of bounded size, as places with the keys found there.

    A crowded cube has several parts, and a crowded place lies in several of them.
    """
    known = points.select(F.col(key).alias("key"), *SPOT).dropna()
    known = materialise(known.withColumn("row", F.monotonically_increasing_id()), "points")
    spots = known.groupBy(*SPOT).agg(F.count(F.lit(1)).alias("n"))
    spots = spots.withColumns(dict(zip("xyz", geo.cube(*map(F.col, SPOT), edge))))
    cubes = spots.groupBy("x", "y", "z").agg(F.ceil(F.sum("n") / PART_POINTS).alias("parts"))
    sizes = spots.join(cubes, ["x", "y", "z"]).withColumn("pieces", F.ceil(F.col("n") / PLACE_POINTS)).drop("n")
    piece = F.col("row") % F.col("pieces")
    part = F.pmod(F.xxhash64(*SPOT, "piece"), F.col("parts"))
    cut = known.join(sizes, SPOT).withColumn("piece", piece).withColumn("part", part)
    pieces = cut.groupBy("x", "y", "z", "part", *SPOT, "piece").agg(F.collect_list("key").alias("keys"))
    place = F.struct(*SPOT, "keys")
    return pieces.groupBy("x", "y", "z", "part").agg(F.sum(F.size("keys")).alias("n"), F.collect_list(place).alias("places"))


def radius_neighbours(points: DataFrame, km: float, key: str = "USAF") -> DataFrame:
    """Pairs (a < b) of points at most `km` apart, with their distance.

    The pairs themselves are the result here; clustering does not use them. They grow with the square of the points in
    reach, whatever the size of the table, so the work is dealt to tasks by pairs of parts of cubes that can be near each
    other and by how many points these could pair. Distances are taken once per pair of places.
    """
    parts = materialise(_parts(points, geo.chord(F.lit(float(km))) * (1 + 1e-9), key), "parts")
    name = F.struct("x", "y", "z", "part")
    at_home = parts.select("x", "y", "z", name.alias("v"), F.col("n").alias("n_v"))
    sent = parts.select("x", "y", "z", name.alias("u"), F.col("n").alias("n_u"))
    for axis in "xyz":
        sent = sent.withColumn(axis, F.explode(geo.around(F.col(axis), 1)))
    work = (F.col("n_u") * F.col("n_v")).alias("work")
    near = materialise(sent.join(at_home, ["x", "y", "z"]).filter("u <= v").select("u", "v", work), "near-parts")
    tasks = math.ceil((near.agg(F.sum("work")).first()[0] or 1) / TASK_PAIRS)
    for side in "uv":
        near = near.join(parts.select(name.alias(side), F.col("places").alias(f"places_{side}")), side)
    near = near.repartition(tasks, "u", "v").withColumn("one", F.col("u") == F.col("v"))

    met = near.select("one", F.explode("places_u").alias("p"), "places_v")
    met = met.select("one", "p", F.explode("places_v").alias("q"))
    apart = geo.haversine_km(F.col("p.LATITUDE"), F.col("p.LONGITUDE"), F.col("q.LATITUDE"), F.col("q.LONGITUDE"))
    met = met.select("one", "p.keys", F.col("q.keys").alias("others"), apart.alias("km")).filter(F.col("km") <= km)
    met = met.select("one", "km", F.explode("keys").alias("a"), "others")
    met = met.select("one", "km", "a", F.explode("others").alias("b"))
    # A part beside itself meets every pair from both ends, two parts meet it once.
    once = F.when(F.col("one"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    return met.filter(once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "km")


# ---- connected components


def components(edges: DataFrame, by: Sequence[str] = ("var",)) -> DataFrame:
    """(node, root): every node of `edges` (u, v) with the least node it is connected to.

    Alternates two steps that hang all neighbours of a node on the least of
    them, until every component is a star around its least node. That takes a
    number of rounds logarithmic in the size of the graph.
    """
    by = list(by)

    def least_neighbour(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.select(*by, "u", "v").union(pairs.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(pairs: DataFrame) -> DataFrame:
        around = both_ways(pairs)
        return (
            around.join(least_neighbour(around), [*by, "u"])
            .filter(F.col("v") > F.col("u"))
            .select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )

    def small_star(pairs: DataFrame) -> DataFrame:
        down = pairs.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = least_neighbour(down)
        hung = down.join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select(*by, "u", F.col("m").alias("v"))
        return hung.union(own).filter(F.col("u") != F.col("v")).distinct()

    def all_stars(pairs: DataFrame) -> bool:
        """Every leaf hangs on one node, and that node on nothing."""
        torn = pairs.groupBy(*by, "u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).drop("n")
        chained = pairs.select(*by, "u").join(pairs.select(*by, F.col("v").alias("u")), [*by, "u"], "left_semi")
        return torn.unionByName(chained).isEmpty()

    stars = edges.filter(F.col("u") != F.col("v")).select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = materialise(stars.distinct(), "edges")
    while not all_stars(stars):
        stars = materialise(small_star(large_star(stars)), "stars")
    leaves = stars.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(*by, F.col("v").alias("node"), F.col("v").alias("root"))
    return leaves.union(roots).distinct()


# ---- DBSCAN

REACH_CELLS = 4  # two spots within a scale's largest reach are at most so many cells apart on each axis
SHRINK = 4
FOREST_EDGES = 1 << 18
CELL = ["kx", "ky", "kz"]


def _scales(reaches: Sequence[float]) -> list[tuple[int, int]]:
    """(first, last) place of the rising reaches of each scale; the last is at most twice the first."""
    out, first = [], 0
    while first < len(reaches):
        last = max(i for i, r in enumerate(reaches) if r <= 2 * reaches[first])
        out.append((first, last))
        first = last + 1
    return out


def _cells(spots: DataFrame, shrink: int) -> DataFrame:
    """Cells of each scale, with their least spot as a sample and whether it is the only one."""
    ids = {k: F.floor(F.col(a) / (F.col("edge") / shrink)).cast("long") for k, a in zip(CELL, "xyz")}
    sample = F.min(F.struct("id", *SPOT))
    alone = F.count(F.lit(1)) == 1
    return spots.withColumns(ids).groupBy("first", *CELL).agg(sample.alias("sample"), alone.alias("single"))


def _near_cells(cells: DataFrame) -> DataFrame:
    """Pairs (u < v by sample) of cells of one scale that are at most `REACH_CELLS` apart on each axis.

    Both meet in cubes as wide as that, so that a cell is sent to 27 places, not to all cells around it.
    """
    home = cells.withColumns({f"c{a}": F.floor(F.col(f"k{a}") / REACH_CELLS).cast("long") for a in "xyz"})
    sent = home
    for a in "xyz":
        sent = sent.withColumn(f"c{a}", F.explode(geo.around(F.col(f"c{a}"), 1)))
    place = ["first", "cx", "cy", "cz"]
    named = ["sample", "single", *CELL]
    left = sent.select(*place, *[F.col(c).alias(f"{c}_u") for c in named])
    right = home.select(*place, *[F.col(c).alias(f"{c}_v") for c in named])
    close = [F.abs(F.col(f"{k}_u") - F.col(f"{k}_v")) <= REACH_CELLS for k in CELL]
    cube = F.xxhash64("cx", "cy", "cz").alias("cube")
    return (
        left.join(right, place)
        .filter((F.col("sample_u.id") < F.col("sample_v.id")) & close[0] & close[1] & close[2])
        .select("first", cube, F.col("sample_u.id").alias("u"), F.col("sample_v.id").alias("v"),
                *[f"{c}_{side}" for side in "uv" for c in named])
    )


def _judged(pairs: DataFrame, reaches: Sequence[float], shrink: int) -> DataFrame:
    """Pairs of (sub-)cells with the least place of a reach that surely links them, and that possibly does.

    Pairs that no reach of their scale can link are left out.
    """
    scales = _scales(reaches)
    known = F.array(*[F.lit(r) for r in reaches])
    last = F.create_map(*[F.lit(x) for scale in scales for x in scale])
    edges = F.create_map(*[F.lit(x) for first, _ in scales for x in (first, _edge(reaches[first]) / shrink)])

    def place(km: Column) -> Column:
        return F.greatest(count_below(known, km, len(reaches), inclusive=False), F.col("first"))

    gap = F.lit(0.0)
    for k in CELL:
        apart = F.greatest(F.abs(F.col(f"{k}_u") - F.col(f"{k}_v")) - 1, F.lit(0)) * F.element_at(edges, F.col("first"))
        gap = gap + apart * apart
    gap_km = F.asin(F.least(F.sqrt(gap) / 2, F.lit(1.0))) * (2 * geo.EARTH_RADIUS_KM)
    km = geo.haversine_km(
        F.col("sample_u.LATITUDE"), F.col("sample_u.LONGITUDE"), F.col("sample_v.LATITUDE"), F.col("sample_v.LONGITUDE")
    )
    alone = F.col("single_u") & F.col("single_v")
    judged = pairs.withColumn("sure", place(km))
    judged = judged.withColumn("possible", F.when(alone, F.col("sure")).otherwise(place(gap_km * (1 - 1e-9) - 1e-9)))
    return judged.filter(F.col("possible") <= F.element_at(last, F.col("first")))


def _edge(reach: float) -> float:
    """Edge of a cell of the unit sphere whose spots are all within reach of each other."""
    return 2 * math.sin(min(reach / (2 * geo.EARTH_RADIUS_KM), math.pi / 2)) * (1 - 1e-9) / math.sqrt(3)


def _reach_edges(spots: DataFrame, reaches: Sequence[float]) -> DataFrame:
    """(cube, u, v, level): links between spots that connect, up to the reach with place `level`, what that reach connects.

    Reaches of one scale share cells, whose spots are all within reach of each other. A pair of cells
    near each other is settled by one sample spot each or by the gap between the
    cells, when these tell at which of the reaches the cells link; else both are
    cut into smaller ones that are asked again, as long as these could link at a smaller reach than the pair is
    known to. Cells are never compared spot by spot, so crowded ones cost no more than others.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(_edge(reaches[a])).alias("edge")) for a, _ in _scales(reaches)]))
    x, y, z = geo.unit_vector(*map(F.col, SPOT))
    spots = spots.withColumns({"x": x, "y": y, "z": z}).withColumn("s", each).select("*", "s.*").drop("s")
    ids = {k: F.floor(F.col(a) / F.col("edge")).cast("long") for k, a in zip(CELL, "xyz")}
    cells = materialise(_cells(spots, 1), "cells")
    inside = spots.withColumns(ids).select("first", *CELL, F.col("id").alias("v"))
    inside = inside.join(cells.select("first", *CELL, F.col("sample.id").alias("u")), ["first", *CELL])
    cube = F.xxhash64(*[F.floor(F.col(k) / REACH_CELLS).cast("long") for k in CELL]).alias("cube")
    links = inside.filter("u <> v").select(cube, "u", "v", F.col("first").alias("level"))
    open_, shrink = _near_cells(cells), 1
    pair = Window.partitionBy("first", "u", "v")
    while True:
        judged = _judged(open_, reaches, shrink).withColumn("best", F.min("sure").over(pair))
        judged = materialise(judged, "settled")
        found = judged.filter(F.col("sure") == F.col("best")).filter(F.col("best") < len(reaches))
        links = links.unionByName(found.select("cube", "u", "v", F.col("best").alias("level")))
        unsure = judged.filter((F.col("possible") < F.col("best")) & ~(F.col("single_u") & F.col("single_v")))
        if unsure.isEmpty():
            return links
        shrink *= SHRINK
        smaller = _cells(spots, shrink)
        open_ = unsure.drop("sure", "possible", "best")
        for side in "uv":
            up = {f"{k}_{side}": F.floor(F.col(f"new_{k}") / SHRINK).cast("long") for k in CELL}
            child = smaller.withColumnsRenamed({c: f"new_{c}" for c in ("sample", "single", *CELL)}).withColumns(up)
            open_ = open_.join(child, ["first", *up])
            open_ = open_.withColumns({f"{c}_{side}": F.col(f"new_{c}") for c in ("sample", "single", *CELL)})
            open_ = open_.drop(*[f"new_{c}" for c in ("sample", "single", *CELL)])


def _forests(edges: DataFrame) -> DataFrame:
    """Fewer edges (cube, u, v, level) that connect the same nodes at every level.

    Neighbouring edges, a bounded number at a time, are replaced by a least spanning forest of
    their own; an edge of the least spanning forest of all is in that of its part.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def forest() -> pd.DataFrame:
            part = pd.concat(held).sort_values(["level", "u", "v"], kind="stable")
            names, _ = pd.factorize(np.concatenate([part["u"], part["v"]]))
            parent = list(range(int(names.max()) + 1))
            keep = np.zeros(len(part), bool)
            for i, (a, b) in enumerate(zip(names[: len(part)].tolist(), names[len(part) :].tolist(), strict=True)):
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[b] != b:
                    parent[b] = b = parent[parent[b]]
                if a != b:
                    parent[a], keep[i] = b, True
            return part[keep]

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= FOREST_EDGES:
                yield forest()
                held = []
        if sum(map(len, held)):
            yield forest()

    ordered = edges.repartitionByRange("cube", "u").sortWithinPartitions("cube", "u")
    return ordered.mapInPandas(thin, edges.schema)


def _cuts(forest: DataFrame, levels: int) -> DataFrame:
    """(var, u, v): at every level, the nodes that neighbouring edges connect, each with the least of them.

    What a bounded number of edges connects is settled in a task; only groups that reach over several such portions are
    left to be put together.
    """

    def stars(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names, places = np.unique(np.concatenate([part["u"], part["v"]]).astype(str), return_inverse=True)
        names = names.astype(object)
        root = np.arange(len(names))
        ends = pd.DataFrame({"a": places[: len(part)], "b": places[len(part) :], "level": part["level"].to_numpy()})
        by_level = {level: rows[["a", "b"]].to_numpy() for level, rows in ends.groupby("level")}
        for level in range(levels):
            for a, b in by_level.get(level, np.zeros((0, 2), int)).tolist():
                a, b = int(root[a]), int(root[b])
                while root[a] != a:
                    a = int(root[a])
                while root[b] != b:
                    b = int(root[b])
                root[max(a, b)] = min(a, b)
            while (root[root] != root).any():
                root = root[root]
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"var": np.full(len(tied), level, np.int32), "u": names[tied], "v": names[root[tied]]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= FOREST_EDGES:
                yield from stars(pd.concat(held))
                held = []
        if sum(map(len, held)):
            yield from stars(pd.concat(held))

    ordered = forest.repartitionByRange("cube", "u").sortWithinPartitions("cube", "u")
    return ordered.mapInPandas(each, "var int, u string, v string")


def dbscan(stations: DataFrame, candidates: Sequence[float]) -> DataFrame:
    """(var, USAF, label): stations linked by steps of at most `var` km share a label, their least USAF.

    All candidates are cuts through one forest of links between distinct places: its edges know the least candidate that
    has them. Jobs do not grow in number with the candidates.
    """
    reaches = sorted({float(c) for c in candidates})
    placed = stations.filter(F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull())
    spots = materialise(placed.groupBy(*SPOT).agg(F.min("USAF").alias("id")), "spots")
    edges = materialise(_forests(_reach_edges(spots, reaches)), "forest")
    # The second time by place alone, links of all scales together.
    home = spots.select(F.col("id").alias("u"), F.xxhash64(*geo.cube(*map(F.col, SPOT), F.lit(_edge(2 * reaches[-1])))).alias("cube"))
    edges = materialise(_forests(edges.drop("cube").join(home, "u").select("cube", "u", "v", "level")), "forest")
    roots = components(_cuts(edges, len(reaches))).withColumnRenamed("node", "id")
    every = spots.withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(len(reaches) - 1))))
    labelled = every.join(roots, ["var", "id"], "left").select("var", *SPOT, F.coalesce("root", "id").alias("label"))
    reach = F.get(F.array(*[F.lit(r) for r in reaches]), F.col("var")).alias("var")
    return placed.join(labelled, SPOT).select(reach, "USAF", "label")


# ---- mean shift


def _cell_sums(spots: DataFrame, shrink: int) -> DataFrame:
    """Weight and coordinate sums of spots per cell of edge var / shrink."""
    ids = {f"k{a}": F.floor(F.col(c) / (F.col("var") / shrink)).cast("long") for a, c in zip("yx", SPOT)}
    return (
        spots.withColumns(ids)
        .groupBy("var", "ky", "kx")
        .agg(
            F.sum("weight").alias("n"),
            F.sum(F.col("LATITUDE") * F.col("weight")).alias("sum_lat"),
            F.sum(F.col("LONGITUDE") * F.col("weight")).alias("sum_lon"),
        )
    )


def _disc_sums(seeds: DataFrame, spots: DataFrame, levels: int) -> DataFrame:
    """Weight and coordinate sums of the spots within `var` of each seed.

    A cell wholly inside the disc contributes its sums, a cell wholly outside
    nothing; only cells on the rim are cut further, and only the rim cells of
    the last level are compared spot by spot.
    """
    who = ["var", "seed_lat", "seed_lon"]
    rim, shrink, parts = None, 1, []
    for level in range(levels):
        sums = _cell_sums(spots, shrink)
        if level == 0:
            rim = seeds.select(*who)
            for a, c in zip("yx", ("seed_lat", "seed_lon")):
                cell = F.floor(F.col(c) / F.col("var")).cast("long")
                rim = rim.withColumn(f"k{a}", F.explode(F.sequence(cell - 1, cell + 1)))
            near = rim.join(sums, ["var", "ky", "kx"])
        else:
            up = {f"u{a}": F.floor(F.col(f"k{a}") / 4).cast("long") for a in "yx"}
            near = rim.withColumnsRenamed({"ky": "uy", "kx": "ux"}).join(sums.withColumns(up), ["var", "uy", "ux"])
        edge = F.col("var") / shrink
        closest, farthest = F.lit(0.0), F.lit(0.0)
        for a, c in zip("yx", ("seed_lat", "seed_lon")):
            low, high = F.col(f"k{a}") * edge - F.col(c), (F.col(f"k{a}") + 1) * edge - F.col(c)
            gap = F.greatest(low, -high, F.lit(0.0))
            reach = F.greatest(F.abs(low), F.abs(high))
            closest, farthest = closest + gap * gap, farthest + reach * reach
        radius = F.col("var")
        judged = near.withColumn("inside", F.sqrt(farthest) <= radius * (1 - 1e-9)).filter(
            F.sqrt(closest) <= radius * (1 + 1e-9)
        )
        parts.append(judged.filter("inside").select(*who, "n", "sum_lat", "sum_lon"))
        rim = judged.filter("not inside").select(*who, "ky", "kx")
        shrink *= 4
    last = shrink // 4
    ids = {f"k{a}": F.floor(F.col(c) / (F.col("var") / last)).cast("long") for a, c in zip("yx", SPOT)}
    away = F.sqrt(
        (F.col("LATITUDE") - F.col("seed_lat")) ** 2 + (F.col("LONGITUDE") - F.col("seed_lon")) ** 2
    )
    parts.append(
        rim.join(spots.withColumns(ids), ["var", "ky", "kx"])
        .filter(away <= F.col("var"))
        .select(
            *who,
            F.col("weight").alias("n"),
            (F.col("LATITUDE") * F.col("weight")).alias("sum_lat"),
            (F.col("LONGITUDE") * F.col("weight")).alias("sum_lon"),
        )
    )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*who).agg(
        F.sum("n").alias("n"), F.sum("sum_lat").alias("sum_lat"), F.sum("sum_lon").alias("sum_lon")
    )


def _modes(spots: DataFrame, levels: int, most_turns: int) -> DataFrame:
    """(var, lat, lon, n): where the seeds come to rest, with the weight around them.

    Every spot starts as a seed. Seeds that have moved to the same place go on
    as one.
    """
    seeds = spots.select("var", F.col("LATITUDE").alias("seed_lat"), F.col("LONGITUDE").alias("seed_lon"))
    modes = None
    for _ in range(most_turns):
        means = _disc_sums(seeds, spots, levels).select(
            "var",
            "n",
            "seed_lat",
            "seed_lon",
            F.round(F.col("sum_lat") / F.col("n"), 9).alias("lat"),
            F.round(F.col("sum_lon") / F.col("n"), 9).alias("lon"),
        )
        moved = F.sqrt((F.col("lat") - F.col("seed_lat")) ** 2 + (F.col("lon") - F.col("seed_lon")) ** 2)
        rests = moved <= F.col("var") * 1e-3
        means = materialise(means.withColumn("rests", rests), "shift")
        resting = means.filter("rests").groupBy("var", "lat", "lon").agg(F.max("n").alias("n"))
        modes = resting if modes is None else modes.unionByName(resting)
        seeds = means.filter("not rests").select("var", F.col("lat").alias("seed_lat"), F.col("lon").alias("seed_lon"))
        seeds = seeds.distinct()
        if seeds.isEmpty():
            break
    else:
        raise RuntimeError(f"seeds still move after {most_turns} turns; allow more with most_turns")
    return materialise(modes.groupBy("var", "lat", "lon").agg(F.max("n").alias("n")), "modes")


def _planar_pairs(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Points joined with the centers (`c_*`) at most `var` degrees away."""
    cell = {a: F.floor(F.col(c) / F.col("var")).cast("long") for a, c in zip("yx", ("lat", "lon"))}
    sent = points.withColumns(cell)
    for axis in "yx":
        sent = sent.withColumn(axis, F.explode(geo.around(F.col(axis), 1)))
    homes = centers.withColumns(cell).withColumnsRenamed({"lat": "c_lat", "lon": "c_lon", "n": "c_n"})
    away = F.sqrt((F.col("lat") - F.col("c_lat")) ** 2 + (F.col("lon") - F.col("c_lon")) ** 2)
    return sent.join(homes, ["var", "y", "x"]).withColumn("away", away).filter(F.col("away") <= F.col("var"))


def _distinct_modes(modes: DataFrame) -> DataFrame:
    """Modes that no heavier kept mode covers, greedily by (weight, lat, lon).

    Done in rounds. Modes in one cell cover each other, so only the heaviest of
    each cell can be next; it is kept if no heavier undecided mode of the cells
    around covers it, and then everything it covers is dropped. Each mode meets
    only the heaviest ones around it, never all of its neighbours.
    """
    edge = F.col("var") / math.sqrt(2)
    cell = {a: F.floor(F.col(c) / edge).cast("long") for a, c in zip("yx", ("lat", "lon"))}
    open_, kept = modes, None
    while True:
        placed = open_.withColumns(cell)
        tops = placed.groupBy("var", "y", "x").agg(F.max(F.struct("n", "lat", "lon")).alias("top"))
        sent = tops
        for axis in "yx":
            sent = sent.withColumn(axis, F.explode(geo.around(F.col(axis), 2)))
        away = F.sqrt((F.col("lat") - F.col("top.lat")) ** 2 + (F.col("lon") - F.col("top.lon")) ** 2)
        beaten = (
            sent.join(placed, ["var", "y", "x"])
            .filter((F.struct("n", "lat", "lon") > F.col("top")) & (away <= F.col("var")))
            .select("var", "top")
            .distinct()
        )
        winners = tops.join(beaten, ["var", "top"], "left_anti").select("var", "top.*")
        covered = _planar_pairs(open_, winners).groupBy("var", "lat", "lon").agg(F.min("away").alias("away"))
        decided = open_.join(covered, ["var", "lat", "lon"], "left")
        decided = materialise(decided, "decided-modes")
        top = decided.filter(F.col("away") == 0).drop("away")
        kept = top if kept is None else kept.unionByName(top)
        open_ = decided.filter(F.col("away").isNull()).drop("away")
        if open_.isEmpty():
            return kept


def meanshift(stations: DataFrame, candidates: Sequence[float], most_turns: int = MAX_SHIFTS) -> DataFrame:
    """(var, USAF, label): flat-kernel mean shift with bandwidth `var` degrees.

    Labels number the modes by falling weight; stations farther than a bandwidth
    from every mode get -1. Raises if seeds still move after `most_turns` turns.
    """
    var = F.explode(F.array(*[F.lit(float(c)) for c in candidates]))
    tried = stations.groupBy(*SPOT).agg(F.count(F.lit(1)).alias("weight")).select("*", var.alias("var"))
    spots = materialise(tried, "spots")
    levels = max(1, math.ceil(math.log(max(1.0, spots.count() / len(candidates) / 1024), 16)) + 1)
    kept = _distinct_modes(_modes(spots, levels, most_turns))
    order = Window.partitionBy("var").orderBy(F.desc("n"), F.desc("lat"), F.desc("lon"))
    numbered = kept.withColumn("label", F.row_number().over(order) - 1)
    points = spots.select("var", F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lon"))
    nearest = _planar_pairs(points, numbered).groupBy("var", "lat", "lon").agg(
        F.min(F.struct("away", "label"))["label"].alias("label")
    )
    labelled = nearest.select("var", F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), "label")
    everyone = stations.select("USAF", *SPOT, var.alias("var"))
    return everyone.join(labelled, ["var", *SPOT], "left").select(
        "var", "USAF", F.coalesce("label", F.lit(-1)).alias("label")
    )


# ---- choosing and finishing

ALGORITHMS = {"dbscan": dbscan, "meanshift": meanshift}


def _algorithm(name: str):
    if name not in ALGORITHMS:
        warnings.warn(f"unknown clustering algorithm {name!r}, using meanshift")
        name = "meanshift"
    return name, ALGORITHMS[name]


def cluster_count(labels: DataFrame, min_size: int = 1) -> DataFrame:
    """(var, clusters): clusters of at least `min_size` members; label -1 is none."""
    sizes = labels.groupBy("var", "label").agg(F.count(F.lit(1)).alias("n"))
    real = (F.col("label").cast("string") != "-1") & (F.col("n") >= min_size)
    return sizes.groupBy("var").agg(F.count_if(real).alias("clusters"))


def closest_var(counts: DataFrame, desired: int) -> DataFrame:
    """The candidate whose cluster count is nearest to `desired`, the first one on a tie."""
    off = F.struct(F.abs(F.col("clusters") - desired), F.col("var"))
    return counts.agg(F.min_by("var", off).alias("var"), F.min_by("clusters", off).alias("clusters"))


def scan_bandwidth(
    stations: DataFrame,
    desired: int,
    min_size: int = 1,
    algorithm: str = "meanshift",
    candidates: Sequence[float] | None = None,
) -> float:
    name, cluster = _algorithm(algorithm)
    tried = candidates or spaced(*map(float, VAR_RANGES[name][:2]), VAR_RANGES[name][2])
    return closest_var(cluster_count(cluster(stations, tried), min_size), desired).first()["var"]


def cluster_centroids(stations: DataFrame) -> DataFrame:
    return stations.groupBy("cluster_num").agg(
        F.avg("LATITUDE").alias("center_lat"), F.avg("LONGITUDE").alias("center_lon"), F.count(F.lit(1)).alias("n")
    )


def nearest_to_centroid(stations: DataFrame) -> DataFrame:
    """Per cluster the member closest to its centre by great-circle distance, the least USAF on a tie."""
    joined = attach(stations, cluster_centroids(stations).drop("n"), ["cluster_num"])
    km = geo.haversine_km(F.col("LATITUDE"), F.col("LONGITUDE"), F.col("center_lat"), F.col("center_lon"))
    best = joined.withColumn("km", F.round(km, 9)).groupBy("cluster_num").agg(F.min(F.struct("km", "USAF")).alias("_b"))
    return best.select("cluster_num", "_b.USAF", "_b.km")


def flag_centroids(stations: DataFrame) -> DataFrame:
    """Mark one station per cluster with `is_centroid`."""
    chosen = nearest_to_centroid(stations).select("cluster_num", "USAF", F.lit(True).alias("_chosen"))
    return (
        stations.join(chosen, ["cluster_num", "USAF"], "left")
        .withColumn("is_centroid", F.col("_chosen").isNotNull())
        .drop("_chosen")
    )


def split_centroids(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Centroid stations and the others."""
    return stations.filter("is_centroid"), stations.filter(~F.col("is_centroid"))


def keep_valid_clusters(stations: DataFrame, min_size: int) -> DataFrame:
    sizes = stations.groupBy("cluster_num").agg(F.count(F.lit(1)).alias("n"))
    return attach(stations, sizes.filter(F.col("n") >= min_size), ["cluster_num"], "left_semi")


def centroid_sanity(stations: DataFrame) -> DataFrame:
    """Clusters that do not have exactly one centroid; empty when all is well."""
    marked = stations.groupBy("cluster_num").agg(F.count_if("is_centroid").alias("centroids"))
    return marked.filter(F.col("centroids") != 1)


def in_order(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows numbered by rising `column`, without bringing them to one task."""
    parts = rows.repartitionByRange(column).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts, "ranges").withColumn("_key", F.lit(0))
    return row_index(parts, column, ["_key"], F.col("_part"), name).drop("_part", "_key")


def clusterize(
    stations: DataFrame,
    desired: int = 20,
    min_size: int = 2,
    algorithm: str = "meanshift",
    var: float | None = None,
    candidates: Sequence[float] | None = None,
) -> DataFrame:
    """Cluster stations, mark the most central one of each cluster, keep clusters of `min_size` or more."""
    name, cluster = _algorithm(algorithm)
    if var is None:
        var = scan_bandwidth(stations, desired, min_size, name, candidates)
    labels = cluster(stations, [var]).filter(F.col("label").cast("string") != "-1")
    numbers = in_order(labels.select("label").distinct(), "label", "cluster_num")
    numbered = labels.join(numbers, "label").select("USAF", "cluster_num")
    clustered = materialise(stations.join(numbered, "USAF"), "clustered")
    kept = materialise(keep_valid_clusters(flag_centroids(clustered), min_size), "clusters")
    if not centroid_sanity(kept).isEmpty():
        raise RuntimeError("a cluster has no or several centroids")
    return kept
