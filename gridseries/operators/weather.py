"""Weather observations: extremes, cluster means, wide tables and the cleaning chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.operators.quality import availability, drop_sparse, outside
from gridseries.operators.quantiles import attach, exact_quantiles
from gridseries.operators.repair import INTERPOLATION_LIMIT, SHORT_GAP, fill_climatology, fill_short_gaps
from gridseries.operators.timegrid import carry, regrid, spine, time_span
from gridseries.session import materialise

CLUSTER_SERIES = ("var", "cluster_num")
FINE_STEP = 300
EXTREME_FACTOR = 1.3
EXTREME_QUANTILE = 0.99


def parse_date_hrmn(obs: DataFrame) -> DataFrame:
    """`Date` (yyyyMMdd) and `HrMn` (possibly unpadded) become `Period`."""
    hhmm = F.when(F.length("HrMn") < 4, F.lpad("HrMn", 4, "0")).otherwise(F.col("HrMn"))
    period = F.to_timestamp_ntz(F.concat_ws(" ", "Date", hhmm), F.lit("yyyyMMdd HHmm"))
    return obs.withColumn("Period", period).drop("Date", "HrMn")


def null_out_extremes(
    obs: DataFrame,
    variables: Sequence[str],
    factor: float = EXTREME_FACTOR,
    q: float = EXTREME_QUANTILE,
    signed: bool = False,
) -> DataFrame:
    """Null values beyond `factor` times the high or below the low quantile over `factor`.

    All quantiles come from the data as given, before any value is nulled. The
    default divides a negative low quantile as well, which raises that limit;
    `signed=True` multiplies it instead.
    """
    wanted = {}
    for v in variables:
        wanted |= {f"{v}__low": (v, 1 - q), f"{v}__high": (v, q)}
    limits = exact_quantiles(obs, [], wanted)
    judged = attach(obs, limits, [])
    cleaned = {}
    for v in variables:
        value, low, high = F.col(v), F.col(f"{v}__low"), F.col(f"{v}__high")
        if signed:
            low = F.when(low < 0, low * factor * factor).otherwise(low)
            high = F.when(high < 0, high / (factor * factor)).otherwise(high)
        cleaned[v] = F.when(~outside(value, low, high, factor), value)
    return judged.withColumns(cleaned).drop(*wanted)


def with_cluster(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Add the station's cluster; observations of other stations drop out."""
    return obs.join(stations.select("USAF", "cluster_num"), "USAF")


def cluster_means(obs: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Mean over the member stations of a cluster per Period, skipping nulls."""
    return obs.groupBy("Period", "cluster_num").agg(*[F.avg(v).alias(v) for v in variables])


def to_long(means: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(var, cluster_num, Period, TS): every variable of every cluster is a series."""
    return means.unpivot(["cluster_num", "Period"], list(variables), "var", "TS")


def pivot_station(obs: DataFrame, var: str, stations: Sequence[str]) -> DataFrame:
    """One column per listed station. The list is given: no extra job, a fixed column order."""
    return obs.groupBy("Period").pivot("USAF", list(stations)).agg(F.first(var, ignorenulls=True))


def pivot_clusters(long: DataFrame, names: Sequence[tuple[str, int]]) -> DataFrame:
    """Wide table with `<var>_<cluster>` columns for the listed (var, cluster) pairs."""
    columns = [
        F.max(F.when((F.col("var") == var) & (F.col("cluster_num") == k), F.col("TS"))).alias(f"{var.strip()}_{k}")
        for var, k in names
    ]
    return long.groupBy("Period").agg(*columns)


def cluster_names(long: DataFrame) -> list[tuple[str, int]]:
    """The (var, cluster) pairs present; there are as many as feature columns."""
    return [(r["var"], r["cluster_num"]) for r in long.select("var", "cluster_num").distinct().sort("var", "cluster_num").collect()]


def station_mean(long: DataFrame) -> DataFrame:
    """Mean over the clusters of each variable per Period."""
    return long.groupBy("var", "Period").agg(F.avg("TS").alias("TS"))


def preprocess(obs: DataFrame, stations: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Restrict to known stations, null extremes, average per cluster; long result."""
    kept = obs.join(stations.select("USAF"), "USAF", "left_semi")
    cleaned = null_out_extremes(kept, variables)
    if "cluster_num" not in stations.columns:
        stations = stations.withColumn("cluster_num", F.col("USAF"))
    return to_long(cluster_means(with_cluster(cleaned, stations), variables), variables)


def resample(
    long: DataFrame,
    step: int,
    fine_step: int = FINE_STEP,
    limit: int = INTERPOLATION_LIMIT,
    by: Sequence[str] = CLUSTER_SERIES,
) -> DataFrame:
    """(series, Period, idx, TS) at every `step`, as if interpolated on a grid of `fine_step` seconds and thinned out.

    The fine grid is never written. Only readings on it count; a slot between two of them lies on the line
    that joins them, if it is at most `limit` fine steps after the first. All series get the grid from the first to the last
    reading of any; slots before the first or after the last reading of a series are empty.
    """
    by = list(by)
    at = clock.epoch_seconds(F.col("Period"))
    span = time_span(long, fine_step, by)
    ends = span.agg(F.min("first_slot").alias("a"), F.max("last_slot").alias("b")).first()
    if ends["a"] is None:
        return regrid(long, step, by)
    first, last = (F.lit(x // step * step).cast("long") for x in ends)
    slots = spine(span.select(*by, first.alias("first_slot"), last.alias("last_slot")), step, by)
    readings = long.filter((at % fine_step == 0) & F.col("TS").isNotNull())
    events = readings.select(*by, "Period", "TS").unionByName(slots.select(*by, "Period", F.lit(True).alias("slot")), True)
    # A reading on a slot and the slot are one event.
    merged = events.groupBy(*by, "Period").agg(F.max("TS").alias("TS"), F.count("slot").alias("slot"))
    merged = merged.withColumn("at", at)
    known = F.when(F.col("TS").isNotNull(), F.struct("at", "TS"))
    near = carry(merged, known, "Period", by, before="_left", after="_right").filter("slot > 0")
    left, right = F.col("_left"), F.col("_right")
    reach = left.isNotNull() & right.isNotNull() & (F.col("at") - left["at"] <= limit * fine_step)
    steps, apart = (F.floor((to - left["at"]) / fine_step) for to in (F.col("at"), right["at"]))
    line = left["TS"] + (right["TS"] - left["TS"]) * steps / apart
    on_grid = (F.col("at") % fine_step == 0) & F.col("TS").isNull() & reach
    return near.select(
        *by,
        "Period",
        F.floor((F.col("at") - first) / step).alias("idx"),
        F.when(on_grid, line).otherwise(F.col("TS")).alias("TS"),
    )


def postprocess(
    long: DataFrame,
    step: int,
    min_quality: float = 98.0,
    fine_step: int = FINE_STEP,
    limit: int = INTERPOLATION_LIMIT,
    short_gap: int = SHORT_GAP,
    by: Sequence[str] = CLUSTER_SERIES,
) -> DataFrame:
    """Interpolate readings at every `step`, drop sparse series, fill what is left.

    Short gaps are interpolated, longer ones get the mean of their month and hour.
    """
    coarse = materialise(resample(long, step, fine_step, limit, by), "resampled")
    dense = drop_sparse(coarse, min_quality, by)
    short = fill_short_gaps(dense, short_gap, by)
    return fill_climatology(materialise(short, "short-gaps"), by)


def join_weather(load: DataFrame, wide: DataFrame) -> DataFrame:
    """Weather columns beside each load row; rows without weather keep nulls."""
    return load.join(wide, "Period", "left")


def good_stations(obs: DataFrame, max_gap: int, min_quality: float) -> DataFrame:
    """Stations whose availability exceeds `min_quality` percent."""
    return availability(obs, max_gap).filter(F.col("availability") > min_quality).select("USAF")


def seconds(text: str) -> int:
    """"1h", "30 min", "2 days" in seconds."""
    number = "".join(c for c in text if c.isdigit())
    unit = text[len(number):].strip().lower()
    scale = {"s": 1, "min": 60, "t": 60, "h": clock.HOUR, "d": clock.DAY, "day": clock.DAY, "days": clock.DAY}
    return int(number or 1) * scale[unit]
