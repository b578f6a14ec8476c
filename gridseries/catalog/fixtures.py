"""Series, stations, observations and runs derived from the driver's tables.

Each fixture has a Spark form (function) and a DuckDB form (entry of `SQL`, in
dependency order) that give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.functions import clock
from gridseries.operators.timegrid import row_index


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _money(column: str):
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def h(spark, sf):
    """Hourly series over all events."""
    events = table(spark, sf, "events")
    hour = clock.floor_to(F.col("ts"), clock.HOUR)
    return events.groupBy(F.lit("all").alias("series_id"), hour.alias("Period")).agg(_money("value").alias("TS"))


def ht(spark, sf):
    """One gappy hourly series per event type."""
    events = table(spark, sf, "events")
    hour = clock.floor_to(F.col("ts"), clock.HOUR)
    return events.groupBy(F.col("event_type").alias("series_id"), hour.alias("Period")).agg(_money("value").alias("TS"))


def hz(spark, sf):
    """The hourly series with zeros and spikes put in."""
    idx = F.col("idx")
    zero = (idx % 97 == 10) | idx.isin(200, 201) | idx.between(300, 304)
    value = F.when(zero, 0.0).when(idx % 131 == 7, F.col("TS") * 8).otherwise(F.col("TS"))
    return row_index(h(spark, sf)).select("series_id", "Period", "idx", value.alias("TS"))


def d(spark, sf):
    """Daily series over seven calendar years."""
    orders = table(spark, sf, "orders")
    return orders.groupBy(F.lit("orders").alias("series_id"), F.col("o_orderdate").alias("Period")).agg(
        _money("o_totalprice").alias("TS")
    )


def st(spark, sf):
    """Weather stations."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.lpad(key.cast("string"), 6, "0").alias("USAF"),
        (F.lit(49.0) + ((key * 37) % 1200).cast("double") / 100).alias("LATITUDE"),
        (F.lit(-8.0) + ((key * 53) % 1000).cast("double") / 100).alias("LONGITUDE"),
    )


def ob_raw(spark, sf):
    """Irregular observations with several readings per station and time."""
    return table(spark, sf, "lineitem").select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("USAF"),
        F.col("l_shipdate").alias("Period"),
        F.col("l_orderkey").alias("ord1"),
        F.col("l_linenumber").alias("ord2"),
        F.when(F.col("l_orderkey") % 503 == 0, F.col("l_quantity") * 5).otherwise(F.col("l_quantity")).alias("W_Spd"),
        (F.col("l_extendedprice") / 1000 - 20).alias("Air_Temp"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("RHx"),
    )


def ob(spark, sf):
    """Observations, the first reading per station and time."""
    from gridseries.operators.repair import keep_first

    return keep_first(ob_raw(spark, sf), ["USAF", "Period"], ["ord1", "ord2"]).drop("ord1", "ord2")


def gz(spark, sf):
    """Gazetteer of places with region, population and feature class."""
    key = F.col("n_nationkey")
    region = table(spark, sf, "region")
    return (
        table(spark, sf, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("NAME"),
            F.col("r_name").alias("admin1"),
            key.alias("ord"),
            (F.lit(49.0) + ((key * 97) % 1200).cast("double") / 100).alias("LATITUDE"),
            (F.lit(-8.0) + ((key * 61) % 1000).cast("double") / 100).alias("LONGITUDE"),
            ((key * 7919) % 1000).alias("POP_MIN"),
            F.col("r_name").alias("ADM0_A3"),
            F.when(key % 5 == 0, "Admin-0 capital").otherwise("Populated place").alias("FEATURECLA"),
        )
    )


def run(spark, sf):
    """Experiment runs, some without a flag."""
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        order.alias("RUN_ID"),
        F.when(cust % 7 == 0, None)
        .when(cust % 2 == 0, "batch_size_benchmark")
        .otherwise("lr_benchmark")
        .alias("flag"),
        F.col("o_orderstatus").alias("location"),
        F.when(cust % 4 == 0, "CuDNNLSTM")
        .when(cust % 4 == 1, "LSTM")
        .when(cust % 4 == 2, "GRU")
        .otherwise("CNN")
        .alias("model_type"),
        F.when(order % 4 == 0, 8).when(order % 4 == 1, 32).when(order % 4 == 2, 64).otherwise(128).alias("batch_size"),
        (1 + order % 4).cast("int").alias("layer_count"),
        (32 * (1 + cust % 3)).cast("int").alias("units"),
        (F.col("o_totalprice") / 10000).alias("testing_MAPE"),
        (F.col("o_totalprice") / 12000).alias("training_MAPE"),
        (F.col("o_totalprice") / 100).alias("training_time"),
        (1 + order % 200).cast("int").alias("ran_epochs"),
    )


def j(spark, sf):
    """JSON texts."""
    return table(spark, sf, "events").select("event_id", "props")


def pf(spark, sf):
    """Actual load against the load one day (24 rows) earlier."""
    from gridseries.operators.timegrid import with_neighbours

    shifted = with_neighbours(
        row_index(h(spark, sf)), lambda w: {"forecast": F.lag("TS", 24).over(w)}, before=24
    )
    return shifted.filter(F.col("forecast").isNotNull()).select(
        "series_id", "Period", F.col("TS").alias("actual"), "forecast"
    )


SQL = {
    "h": """select 'all' as series_id, cast(date_trunc('hour', ts) as timestamp) as Period,
        cast(sum(cast(value as decimal(18,2))) as double) as TS from events group by 2""",
    "hi": "select *, row_number() over (partition by series_id order by Period) - 1 as idx from h",
    "ht": """select event_type as series_id, cast(date_trunc('hour', ts) as timestamp) as Period,
        cast(sum(cast(value as decimal(18,2))) as double) as TS from events group by 1, 2""",
    "hti": "select *, row_number() over (partition by series_id order by Period) - 1 as idx from ht",
    "hz": """select series_id, Period, idx,
        case when idx % 97 = 10 or idx in (200, 201) or idx between 300 and 304 then 0.0
             when idx % 131 = 7 then TS * 8 else TS end as TS from hi""",
    "d": """select 'orders' as series_id, cast(o_orderdate as timestamp) as Period,
        cast(sum(cast(o_totalprice as decimal(18,2))) as double) as TS from orders group by 2""",
    "st": """select lpad(cast(s_suppkey as varchar), 6, '0') as USAF,
        49.0 + cast((s_suppkey * 37) % 1200 as double) / 100 as LATITUDE,
        -8.0 + cast((s_suppkey * 53) % 1000 as double) / 100 as LONGITUDE from supplier""",
    "ob_raw": """select lpad(cast(l_suppkey as varchar), 6, '0') as USAF, cast(l_shipdate as timestamp) as Period,
        l_orderkey as ord1, l_linenumber as ord2,
        case when l_orderkey % 503 = 0 then l_quantity * 5 else l_quantity end as W_Spd,
        l_extendedprice / 1000 - 20 as Air_Temp,
        cast(round(l_discount * 1000) as int) as RHx from lineitem""",
    "ob": """select USAF, Period, W_Spd, Air_Temp, RHx from (select *, row_number() over
        (partition by USAF, Period order by ord1, ord2) as rn from ob_raw) q where rn = 1""",
    "gz": """select n_name as NAME, r_name as admin1, n_nationkey as ord,
        49.0 + cast((n_nationkey * 97) % 1200 as double) / 100 as LATITUDE,
        -8.0 + cast((n_nationkey * 61) % 1000 as double) / 100 as LONGITUDE,
        (n_nationkey * 7919) % 1000 as POP_MIN, r_name as ADM0_A3,
        case when n_nationkey % 5 = 0 then 'Admin-0 capital' else 'Populated place' end as FEATURECLA
        from nation join region on n_regionkey = r_regionkey""",
    "run": """select o_orderkey as RUN_ID,
        case when o_custkey % 7 = 0 then null when o_custkey % 2 = 0 then 'batch_size_benchmark'
             else 'lr_benchmark' end as flag,
        o_orderstatus as location,
        case o_custkey % 4 when 0 then 'CuDNNLSTM' when 1 then 'LSTM' when 2 then 'GRU' else 'CNN' end as model_type,
        case o_orderkey % 4 when 0 then 8 when 1 then 32 when 2 then 64 else 128 end as batch_size,
        cast(1 + o_orderkey % 4 as int) as layer_count, cast(32 * (1 + o_custkey % 3) as int) as units,
        o_totalprice / 10000 as testing_MAPE, o_totalprice / 12000 as training_MAPE,
        o_totalprice / 100 as training_time, cast(1 + o_orderkey % 200 as int) as ran_epochs from orders""",
    "j": "select event_id, props from events",
    "pf": """select series_id, Period, TS as actual, forecast from (select *, lag(TS, 24) over
        (partition by series_id order by Period) as forecast from h) q where forecast is not null""",
}

NEEDS = {"hi": ["h"], "hti": ["ht"], "hz": ["hi"], "ob": ["ob_raw"], "pf": ["h"]}


def with_sql(names: str, body: str, **extra: str) -> str:
    """`body` behind the fixtures it reads (space-separated `names`) and `extra` named steps."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    steps = {name: SQL[name] for name in wanted} | extra
    listed = ",\n".join(f"{name} as ({text})" for name, text in steps.items())
    return f"with {listed}\n{body}"
