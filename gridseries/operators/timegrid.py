"""Row order at scale: positions, shifted rows, carried values and runs.

A plain `Window.partitionBy(series).orderBy(Period)` sorts a whole series in one
task. The helpers here never do: they order rows inside (series, time bucket),
compute one summary row per bucket, order those few rows per series, and join
the result back. A series that holds a third of all rows spreads over as many
tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.session import match

SERIES = ("series_id",)
BUCKET_DAYS = 30
BLOCK_ROWS = 8192


def time_bucket(ts: Column, days: int = BUCKET_DAYS) -> Column:
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return F.floor(day / F.lit(days)).cast("long")


def row_index(
    df: DataFrame,
    order: str | Sequence[str] = "Period",
    by: Sequence[str] = SERIES,
    bucket: Column | None = None,
    name: str = "idx",
) -> DataFrame:
    """Zero-based position of each row in its series.

    `bucket` must be monotone in the first order column; by default it is a run
    of whole days of that column.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    keyed = df.withColumn("_bucket", time_bucket(F.col(order[0])) if bucket is None else bucket)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    placed = match(keyed.withColumn("_place", F.row_number().over(inside) - 1), offsets, [*by, "_bucket"])
    return placed.withColumn(name, F.col("_offset") + F.col("_place")).drop("_bucket", "_place", "_offset")


def with_neighbours(
    df: DataFrame,
    columns: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    by: Sequence[str] = SERIES,
    block: int | None = None,
) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    Rows are cut into blocks of consecutive `idx`; each block also receives the
    few rows just outside it, so one shuffle serves any number of shifted
    columns and no block grows with its series. `columns` gets the ordered
    window and returns the columns to add.
    """
    by = list(by)
    block = block or max(BLOCK_ROWS, 4 * max(before, after))
    home = F.floor(F.col("idx") / block)
    first = F.floor((F.col("idx") - after) / block)
    last = F.floor((F.col("idx") + before) / block)
    spread = df.withColumn("_block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*by, "_block").orderBy("idx")
    added = [value.alias(key) for key, value in columns(window).items()]
    return spread.select("*", *added).filter(F.col("_block") == home).drop("_block")


def carry(
    df: DataFrame,
    value: Column,
    order: str = "Period",
    by: Sequence[str] = SERIES,
    bucket: Column | None = None,
    before: str | None = "prev",
    after: str | None = "next",
) -> DataFrame:
    """Nearest non-null `value` strictly before and strictly after each row, however far away.

    Pass None for the side that is not needed.
    """
    by = list(by)
    keyed = df.withColumn("_bucket", time_bucket(F.col(order)) if bucket is None else bucket).withColumn("_v", value)
    known = F.when(F.col("_v").isNotNull(), F.col(order))
    sides = []
    if before:
        sides.append((before, F.max_by("_v", known), F.col("_bucket"), F.col(order)))
    if after:
        sides.append((after, F.min_by("_v", known), F.desc("_bucket"), F.desc(order)))
    edges = keyed.groupBy(*by, "_bucket").agg(*[edge.alias(f"_edge_{name}") for name, edge, _, _ in sides])
    out = keyed
    for name, _, bucket_order, row_order in sides:
        beyond = Window.partitionBy(*by).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.withColumn(f"_far_{name}", F.last(f"_edge_{name}", ignorenulls=True).over(beyond))
        inside = Window.partitionBy(*by, "_bucket").orderBy(row_order).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"_near_{name}", F.last("_v", ignorenulls=True).over(inside))
    out = match(out, edges.drop(*[f"_edge_{s[0]}" for s in sides]), [*by, "_bucket"])
    for name, *_ in sides:
        out = out.withColumn(name, F.coalesce(f"_near_{name}", f"_far_{name}")).drop(f"_near_{name}", f"_far_{name}")
    return out.drop("_bucket", "_v")


def running_sum(
    df: DataFrame,
    value: Column,
    name: str,
    order: str = "Period",
    by: Sequence[str] = SERIES,
    bucket: Column | None = None,
) -> DataFrame:
    """Sum of `value` from the start of the series up to and including each row."""
    by = list(by)
    keyed = df.withColumn("_bucket", time_bucket(F.col(order)) if bucket is None else bucket).withColumn("_v", value)
    totals = keyed.groupBy(*by, "_bucket").agg(F.sum("_v").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.sum("_total").over(earlier).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        match(keyed.withColumn("_inside", F.sum("_v").over(inside)), offsets, [*by, "_bucket"])
        .withColumn(name, F.coalesce("_offset", F.lit(0)) + F.col("_inside"))
        .drop("_bucket", "_v", "_inside", "_offset")
    )


def runs(df: DataFrame, flagged: Column, by: Sequence[str] = SERIES) -> DataFrame:
    """Runs of consecutive flagged rows: (run_id, start_idx, end_idx, len).

    Within a run, position minus rank among flagged rows is constant. The
    grouping is pre-aggregated before its shuffle, so a run of any length costs
    one row per task.
    """
    by = list(by)
    hits = df.filter(flagged).select(*by, "idx")
    ranked = row_index(hits, "idx", by, F.floor(F.col("idx") / BLOCK_ROWS), "_rank")
    return (
        ranked.groupBy(*by, (F.col("idx") - F.col("_rank")).alias("run_id"))
        .agg(
            F.min("idx").alias("start_idx"),
            F.max("idx").alias("end_idx"),
            F.count(F.lit(1)).alias("len"),
        )
        .select(*by, "run_id", "start_idx", "end_idx", "len")
    )


def time_span(df: DataFrame, step: int, by: Sequence[str] = SERIES) -> DataFrame:
    """First and last grid slot of each series, as epoch seconds."""
    return df.groupBy(*by).agg(
        clock.floor_epoch(F.min("Period"), step).alias("first_slot"),
        clock.floor_epoch(F.max("Period"), step).alias("last_slot"),
    )


def spine(span: DataFrame, step: int, by: Sequence[str] = SERIES, days: int = BUCKET_DAYS) -> DataFrame:
    """All grid slots between `first_slot` and `last_slot`, one row each, with their `idx`.

    The span is first cut into stretches of `days`, which are spread over the
    cluster before each is expanded, so a long grid is not written by one task.
    The number of partitions is given because the stretches themselves are so
    small that they would be merged into one partition at run time.
    """
    by = list(by)
    tasks = int(span.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = max(1, days * clock.DAY // step) * step
    stretches = span.select(
        *by,
        "first_slot",
        "last_slot",
        F.explode(F.sequence("first_slot", "last_slot", F.lit(stretch).cast("long"))).alias("_from"),
    ).repartition(tasks, *by, "_from")
    until = F.least(F.col("_from") + (stretch - step), F.col("last_slot"))
    return stretches.select(
        *by, "first_slot", F.explode(F.sequence("_from", until, F.lit(step).cast("long"))).alias("_slot")
    ).select(
        *by,
        clock.from_epoch(F.col("_slot")).alias("Period"),
        F.floor((F.col("_slot") - F.col("first_slot")) / step).alias("idx"),
    )


def regrid(
    df: DataFrame,
    step: int,
    by: Sequence[str] = SERIES,
    common_span: bool = False,
) -> DataFrame:
    """Uniform grid of `step` seconds from the first to the last slot of each series.

    Slots align with midnight. Readings that are not exactly on a slot are
    dropped, slots without a reading get nulls. `common_span=True` gives every
    series the grid of all of them together. Periods must be unique per series.
    """
    by = list(by)
    span = time_span(df, step, by)
    if common_span:
        ends = span.agg(F.min("first_slot").alias("a"), F.max("last_slot").alias("b"))
        span = span.select(
            *by,
            ends.select("a").scalar().alias("first_slot"),
            ends.select("b").scalar().alias("last_slot"),
        )
    return match(spine(span, step, by), df.drop("idx"), [*by, "Period"], "left")
