"""Centroid clustering of integer vectors with a LAESA pivot table.

Vectors are scaled and rounded down to integers. Their distances to a few fixed
pivots are computed once and written beside them. In every round the distances
of the centroids to the pivots are taken; by the triangle inequality the
difference of two pivot distances is at most the distance between vector and
centroid, so a centroid whose largest difference is beyond the best distance
found so far cannot be the nearest. Each vector visits its centroids by rising
bound, and only those that survive get an exact integer distance. Bounds are in floating point
with a margin for rounding, distances and sums are whole numbers of any size.

Sums of the clusters are combined per task, then per (cluster, component); only those
totals, one per centroid and component, reach the driver. Rows are never
grouped, so a cluster or a repeated vector with most rows is spread like any other.

Cases: vectors that are null, of another length, or hold a null, an infinity or a
NaN are left out; so are components of 2**128 and more, which no 32-bit float
reaches. Repeated rows and rows with a null id are vectors of their own. A null
id comes last when first centroids are chosen; rows with equal ids are ordered by
their components. With fewer vectors than centroids each gives a centroid. An
empty table gives an empty result. A distance or an inertia beyond a 64-bit
integer is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.session import materialise

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
PIVOTS = 8
PIVOT_CANDIDATES = 64  # pivots are picked among so many vectors, those with the smallest hashes
LARGEST = 2.0**128
SMALL = 1 << 27  # components up to this size have squared distances that fit 64 bits
LIMB = 10**18
LONG_MAX = (1 << 63) - 1

Vector = list[int]


def scaled(batch: pa.RecordBatch, dimensions: int, scale: float) -> tuple[pa.Array, np.ndarray]:
    """Ids and rounded-down components (as whole floats) of the usable rows of a batch (id, v)."""
    lists = batch.column("v")
    fits = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimensions)
    lists = lists.take(pa.array(fits))
    values = lists.flatten()
    rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    good = (known & np.isfinite(rows)).all(axis=1)
    good[good] = (np.abs(rows[good]) < LARGEST).all(axis=1)
    return batch.column("id").take(pa.array(fits[good])), np.floor(scale * rows[good])


def whole(rows: np.ndarray) -> np.ndarray:
    """The same components as 64-bit integers where they are small, else as integers of any size."""
    if not rows.size or np.abs(rows).max() <= SMALL:
        return rows.astype(np.int64)
    return np.array([[int(x) for x in row] for row in rows.tolist()], object)


def squared(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to other rows, pair by pair; both from `whole`."""
    apart = rows - other
    return (apart * apart).sum(axis=1)


@dataclass(frozen=True)
class Centroids:
    """Centroids with their distances to the pivots."""

    vectors: list[Vector]
    to_pivots: list[list[float]]

    @classmethod
    def of(cls, vectors: list[Vector], pivots: list[Vector]) -> Centroids:
        far = [[float(sum((a - b) ** 2 for a, b in zip(v, p, strict=True))) ** 0.5 for p in pivots] for v in vectors]
        return cls(vectors, far)

    def nearest(self, rows: np.ndarray, pivot_distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid and squared distance of each row; how many distances that took."""
        mine = np.array(self.to_pivots)
        apart = np.abs(pivot_distances[:, None, :] - mine[None, :, :])
        margin = 1e-12 * (pivot_distances[:, None, :] + mine[None, :, :])
        bounds = np.maximum(apart - margin, 0.0).max(axis=2) ** 2
        order = np.argsort(bounds, axis=1, kind="stable")
        exact = np.array(self.vectors, object)
        mine_whole = exact.astype(np.int64) if np.abs(exact).max() <= SMALL else exact
        wide = whole(rows)
        cluster = order[:, 0].copy()
        best = squared(wide, mine_whole[cluster])
        taken = len(rows)
        alive = np.arange(len(rows))
        for step in range(1, len(self.vectors)):
            # Bounds rise along the order: a row that stops here has no open centroid left.
            candidate = order[alive, step]
            within = bounds[alive, candidate] <= best[alive].astype(np.float64) * (1 + 1e-12)
            alive, candidate = alive[within], candidate[within]
            if not len(alive):
                break
            distance = squared(wide[alive], mine_whole[candidate])
            taken += len(alive)
            closer = (distance < best[alive]) | ((distance == best[alive]) & (candidate < cluster[alive]))
            best[alive[closer]] = distance[closer]
            cluster[alive[closer]] = candidate[closer]
        return cluster, best, taken


def choose_pivots(candidates: list[Vector], count: int) -> list[Vector]:
    """The first candidate, then always the one with the largest summed distance to the chosen ones."""
    rows = np.array(candidates, np.float64)
    chosen = [0] if len(rows) else []
    far = np.zeros(len(rows))
    while chosen and len(chosen) < min(count, len(rows)):
        far += np.sqrt(((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        far[chosen] = -1.0
        chosen.append(int(np.argmax(far)))
    return [candidates[k] for k in chosen]


def _over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            n = batch.num_rows
            rows = batch.column("v").flatten().to_numpy().reshape(n, -1)
            yield batch.column("id"), rows, batch.column("p").flatten().to_numpy().reshape(n, -1)


def pivot_table(usable: DataFrame, pivots: list[Vector]) -> DataFrame:
    """(id, v, p): every vector with its distances to the pivots, written once to the shared folder."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rows = batch.column("v").flatten().to_numpy().reshape(n, -1)
            far = np.stack([np.sqrt(((rows - np.array(p, np.float64)) ** 2).sum(axis=1)) for p in pivots], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, n * len(pivots) + 1, len(pivots), dtype=np.int32), far.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), lists], ["id", "v", "p"])

    return materialise(usable.mapInArrow(measure, "id long, v array<double>, p array<double>"), "pivot_table")


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: float) -> DataFrame:
    """(id, v) of the vectors that take part, scaled and rounded down."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = scaled(batch, dimensions, scale)
            starts = np.arange(0, rows.size + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(starts, rows.ravel())], ["id", "v"])

    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.mapInArrow(keep, "id long, v array<double>")


def _first(usable: DataFrame, count: int) -> list[Vector]:
    """The `count` vectors whose ids hash lowest, in that order."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    rows = usable.orderBy(F.asc_nulls_last(hashed), "v").select("v").limit(count).collect()
    return [[int(x) for x in row["v"]] for row in rows]


def cluster_sums(table: DataFrame, centroids: Centroids) -> dict[int, tuple[int, Vector]]:
    """Number of vectors and exact sum of each component for every cluster that has vectors."""
    dimensions = len(centroids.vectors[0])
    schema = "cluster int, place int, n long, high decimal(38,0), low decimal(38,0)"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for _, rows, far in _over_batches(batches):
            cluster, _, _ = centroids.nearest(rows, far)
            wide = whole(rows)
            for c in np.unique(cluster).tolist():
                own = wide[cluster == c]
                counts[c] = counts.get(c, 0) + len(own)
                sums[c] = sums.get(c, np.zeros(dimensions, object)) + own.sum(axis=0).astype(object)
        for c, total in sums.items():
            parts = [divmod(int(x), LIMB) for x in total]
            columns = [
                pa.array([c] * dimensions, pa.int32()),
                pa.array(range(dimensions), pa.int32()),
                pa.array([counts[c]] * dimensions, pa.int64()),
                pa.array([Decimal(high) for high, _ in parts], pa.decimal128(38, 0)),
                pa.array([Decimal(low) for _, low in parts], pa.decimal128(38, 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "n", "high", "low"])

    totals = table.mapInArrow(add, schema).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    found: dict[int, tuple[int, Vector]] = {}
    for row in totals.collect():  # centroids x components
        n, vector = found.setdefault(row["cluster"], (row["n"], [0] * dimensions))
        vector[row["place"]] = int(row["high"]) * LIMB + int(row["low"])
    return found


def assign(table: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, cluster, distance) of every vector; a distance beyond 64 bits is null."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, far in _over_batches(batches):
            cluster, distance, _ = centroids.nearest(rows, far)
            fitting = [d if d <= LONG_MAX else None for d in distance.tolist()]
            columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return table.mapInArrow(place, "id long, cluster int, distance long")


def digest(vector: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, vector)).encode()).hexdigest()


def _long_sum(column: str) -> Column:
    """A sum as a long, null where a term is null or the sum does not fit."""
    total = F.sum(F.col(column).cast("decimal(38,0)"))
    whole_sum = F.count(F.lit(1)) == F.count(column)
    return F.when(whole_sum & (total <= LONG_MAX), total.try_cast("long"))


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: float = SCALE,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    The first centroids are the vectors whose ids hash lowest. Each round assigns
    every vector to its nearest centroid (the smaller number on a tie) and moves each
    centroid that has vectors to their mean, rounded down; at the end vectors are
    assigned once more. The mapping code reaches executors through `ship_code`.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col, dimensions, scale)
    first = _first(usable, max(count, PIVOT_CANDIDATES))
    fields = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        nothing = usable.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing.join(spark.createDataFrame([], fields), "cluster").select(id_col, "cluster", "distance", *_report())
    chosen = choose_pivots(first, pivots)
    table = pivot_table(usable, chosen)
    at = first[:count]
    for _ in range(rounds):
        sums = cluster_sums(table, Centroids.of(at, chosen))
        at = [[x // sums[k][0] for x in sums[k][1]] if k in sums else vector for k, vector in enumerate(at)]
    placed = materialise(assign(table, Centroids.of(at, chosen)), "clusters")
    by_cluster = placed.groupBy("cluster").agg(_long_sum("distance").alias("s")).collect()  # one row per centroid
    inertia = [row["s"] for row in by_cluster]
    total = sum(inertia) if None not in inertia and sum(inertia) <= LONG_MAX else None
    report = [(row["cluster"], row["s"], total, digest(at[row["cluster"]])) for row in by_cluster]
    per_cluster = F.broadcast(spark.createDataFrame(report, fields))  # at most `count` rows
    return placed.join(per_cluster, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", *_report())


def _report() -> list[str]:
    return ["cluster_inertia", "inertia", "centroid_sha256"]
