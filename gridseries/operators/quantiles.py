"""Exact interpolated quantiles without gathering a group in one buffer.

The built-in exact `percentile` keeps every distinct value of a group in one
aggregation buffer. Here a bounded sketch (`percentile_approx`) first brackets
each wanted rank, again inside the bracket while that may hold more than
`BRACKET_ROWS` rows; values below the bracket are only counted, values above it
only leave their minimum, and the few values inside are ordered to read off the
exact ranks. Both passes combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions.search import count_below
from gridseries.operators.timegrid import running_sum
from gridseries.session import match, materialise

ACCURACY = 10000
BRACKET_ROWS = 1 << 16
GRID = 100
VALUE_SPLITS = 256


def attach(rows: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group statistics to rows ("inner", "left" or "left_semi"); null keys are a group like any other.

    A group may hold a third of all rows, so the rows should not be shuffled by
    it. `stats` is written out first: the planner then knows its true size and
    broadcasts it while it is below `spark.sql.autoBroadcastJoinThreshold`; only
    a larger table takes a shuffle, where skewed groups are split at run time.
    Without `by`, `stats` is the one row of a global aggregate and becomes
    constants.
    """
    if by:
        return match(rows, materialise(stats, "stats"), by, how)
    only = stats.first()
    return rows.withColumns(
        {field.name: F.lit(only[field.name] if only else None).cast(field.dataType) for field in stats.schema}
    )


def _narrowed(values: DataFrame, brackets: DataFrame, by: list[str], probs: list[list[float]]) -> DataFrame:
    """The same brackets, each cut to about a twentieth: a grid of quantiles of its rows tells where its rank lies."""
    grid = F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])
    found, kept = [], []
    for i, wanted in enumerate(probs):
        k, v, n = len(wanted), F.col(f"_v{i}"), F.col(f"_n{i}")
        lows, highs = [], []
        for at, q in enumerate(wanted):
            low, high = F.get(f"_p{i}", F.lit(at)), F.get(f"_p{i}", F.lit(k + at))
            inside = (low <= v) & (v <= high)
            name = f"{i}_{at}"
            found += [
                F.count_if(v < low).alias(f"_below{name}"),
                F.count_if(inside).alias(f"_inside{name}"),
                F.percentile_approx(F.when(inside, v), grid, F.lit(ACCURACY)).alias(f"_grid{name}"),
            ]
            place = F.lit(float(q)) * (n - 1)
            before, steps = F.col(f"_below{name}"), GRID / F.greatest(F.col(f"_inside{name}") - 1, F.lit(1))
            first = F.floor((F.floor(place) - before) * steps).cast("int") - 2
            last = F.ceil((F.ceil(place) - before) * steps).cast("int") + 2
            lows.append(F.when(first <= 0, low).otherwise(F.get(f"_grid{name}", first)))
            highs.append(F.when(last >= GRID, high).otherwise(F.get(f"_grid{name}", last)))
        kept += [n, F.when(n > 0, F.array(*lows, *highs)).alias(f"_p{i}")]
    ends = [F.first(c).alias(c) for c in brackets.columns if c not in by]
    return attach(values, brackets, by).groupBy(*by).agg(*found, *ends).select(*by, *kept)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    wanted: dict[str, tuple[str, float]],
) -> DataFrame:
    """One row per group with a column per wanted quantile.

    `wanted` maps an output name to (column, probability). Nulls are skipped;
    between two ranks the value is interpolated linearly. Reads `df` twice, so
    write out a `df` that is costly to compute.
    """
    by = list(by)
    columns = sorted({column for column, _ in wanted.values()})
    probs = {c: sorted({q for column, q in wanted.values() if column == c}) for c in columns}
    margin = 2.0 / ACCURACY
    values = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    measured = []
    for i, c in enumerate(columns):
        ends = [F.lit(max(0.0, q - margin)) for q in probs[c]] + [F.lit(min(1.0, q + margin)) for q in probs[c]]
        measured += [
            F.count(f"_v{i}").alias(f"_n{i}"),
            F.percentile_approx(f"_v{i}", F.array(*ends), F.lit(ACCURACY)).alias(f"_p{i}"),
        ]
    brackets = materialise(values.groupBy(*by).agg(*measured), "brackets")
    most = brackets.agg(F.greatest(F.lit(0), *[F.max(f"_n{i}") for i in range(len(columns))])).first()[0]
    held = 4 * most / ACCURACY
    while held > BRACKET_ROWS:
        brackets = materialise(_narrowed(values, brackets, by, [probs[c] for c in columns]), "brackets")
        held = held * 5 / GRID

    # Parts run 0, 1, 2, ... along the value axis: odd parts are brackets, even parts the gaps between.
    marks = []
    for i, c in enumerate(columns):
        v, k = F.col(f"_v{i}"), len(probs[c])
        part = F.lit(2 * k)
        for at in reversed(range(k)):
            low, high = F.get(f"_p{i}", F.lit(at)), F.get(f"_p{i}", F.lit(k + at))
            part = F.when(v < low, 2 * at).when(v <= high, 2 * at + 1).otherwise(part)
        marks.append(
            F.struct(
                F.lit(i).alias("which"),
                part.alias("part"),
                F.when(part % 2 == 1, v).alias("exact"),
                v.alias("v"),
                F.col(f"_n{i}").alias("n"),
            )
        )
    counted = (
        attach(values, brackets, by)
        .select(*by, F.inline(F.array(*marks)))
        .filter(F.col("v").isNotNull())
        .groupBy(*by, "which", "part", "exact")
        .agg(
            F.count(F.lit(1)).alias("c"),
            F.min("v").alias("vmin"),
            F.max("v").alias("vmax"),
            F.max("n").alias("n"),
        )
    )
    upto = Window.partitionBy(*by, "which").orderBy("part", "exact").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("ends", F.sum("c").over(upto)).withColumn("starts", F.col("ends") - F.col("c"))

    def value_at(mine: Column, rank: Column) -> Column:
        value = (
            F.when(F.col("part") % 2 == 1, F.col("exact"))
            .when(rank == F.col("ends") - 1, F.col("vmax"))
            .when(rank == F.col("starts"), F.col("vmin"))
            .otherwise(F.raise_error(F.lit("quantile rank outside its bracket")).cast("double"))
        )
        return F.max(F.when(mine & (F.col("starts") <= rank) & (rank < F.col("ends")), value))

    outputs = []
    for name, (column, q) in wanted.items():
        mine = F.col("which") == columns.index(column)
        place = F.lit(float(q)) * (F.col("n") - 1)
        low, high = value_at(mine, F.floor(place)), value_at(mine, F.ceil(place))
        share = F.max(F.when(mine, place - F.floor(place)))
        outputs.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*by).agg(*outputs)


def quantile_grid(df: DataFrame, value: str, points: int, by: Sequence[str]) -> DataFrame:
    """Values at `points` evenly spaced probabilities, as one sorted array per group.

    Equal values are counted first, so a value that fills a third of the rows is
    one row. The distinct values are ordered in slices of similar size; each
    wanted rank is sent to its slice and reads the value that covers it.
    """
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    probs = F.array(*[F.lit(i / VALUE_SPLITS) for i in range(1, VALUE_SPLITS)])
    cuts = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, probs, F.lit(ACCURACY))).alias("_cuts"))
    slice_of = count_below(F.col("_cuts"), F.col(value), VALUE_SPLITS, inclusive=False)
    sliced = materialise(attach(counts, cuts, by).withColumn("slice", slice_of).drop("_cuts"), "sliced")
    covered = running_sum(sliced, F.col("c"), "ends", value, by, F.col("slice")).withColumn(
        "starts", F.col("ends") - F.col("c")
    )
    totals = sliced.groupBy(*by, "slice").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    layout = (
        totals.withColumn("last", F.sum("c").over(upto))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("last", "slice"))).alias("slices"), F.sum("c").alias("n"))
    )
    place = F.col("point") / (points - 1) * (F.col("n") - 1)
    ranks = (
        layout.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .select(
            *by,
            "point",
            (place - F.floor(place)).alias("share"),
            F.inline(
                F.array(
                    F.struct(F.lit(0).alias("end"), F.floor(place).alias("rank")),
                    F.struct(F.lit(1).alias("end"), F.ceil(place).alias("rank")),
                )
            ),
            "slices",
        )
        .withColumn(
            "slice",
            F.get(
                F.col("slices.slice"),
                count_below(F.col("slices.last"), F.col("rank"), VALUE_SPLITS, inclusive=True),
            ),
        )
        .drop("slices")
    )
    readings = covered.select(
        *by, "slice", F.col("starts").alias("rank"), F.col(value).cast("double").alias("v"), F.lit(0).alias("asks")
    ).unionByName(ranks.withColumn("asks", F.lit(1)), allowMissingColumns=True)
    along = Window.partitionBy(*by, "slice").orderBy("rank", "asks").rowsBetween(Window.unboundedPreceding, 0)
    read = (
        readings.withColumn("at", F.last("v", ignorenulls=True).over(along))
        .filter(F.col("asks") == 1)
        .groupBy(*by, "point")
        .agg(
            F.max(F.when(F.col("end") == 0, F.col("at"))).alias("low"),
            F.max(F.when(F.col("end") == 1, F.col("at"))).alias("high"),
            F.max("share").alias("share"),
        )
        .select(*by, "point", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("v"))
    )
    return read.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("point", "v"))), lambda e: e["v"]).alias("grid")
    )
