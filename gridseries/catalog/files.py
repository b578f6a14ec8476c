"""Queries on file sources and sinks. Spark writes the files from the tables first, then reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.catalog.fixtures import d, ht, ob_raw, st, table, with_sql
from gridseries.catalog.registry import registry
from gridseries.functions import clock
from gridseries.operators import repair, scaling, splits
from gridseries.session import new_folder
from gridseries.sources import loader, sinks

QUERIES, register = registry()


def as_csv(df, name):
    folder = new_folder(df.sparkSession, name)
    df.write.option("header", True).csv(folder)
    return folder


# ---- demand in half hours; some days short, some long

HALF_HOURS = """select cast(time_bucket(interval 30 minutes, ts, timestamp '2000-01-01') as timestamp) as Period,
    cast(sum(cast(value as decimal(18,2))) as double) as TS from events group by 1"""
DEMAND = """select upper(strftime(Period, '%d-%b-%Y')) as SETTLEMENT_DATE,
    cast(hour(Period) * 2 + minute(Period) // 30 + 1 as int) as SETTLEMENT_PERIOD, TS as ND, TS / 2 as ENGLAND_WALES_DEMAND
    from half where day(Period) % 7 <> 3 or hour(Period) * 2 + minute(Period) // 30 + 1 <= 46
    union all select upper(strftime(Period, '%d-%b-%Y')), cast(hour(Period) * 2 + minute(Period) // 30 + 3 as int), TS, TS / 2
    from half where day(Period) % 7 = 5 and hour(Period) = 23"""
STEPS = {"half": HALF_HOURS, "demand": DEMAND}


def demand(spark, sf):
    """UK-style demand: days with 46, 48 and 50 periods."""
    events = table(spark, sf, "events")
    half = events.groupBy(clock.floor_to(F.col("ts"), 1800).alias("Period")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("TS")
    )
    number = F.hour("Period") * 2 + F.floor(F.minute("Period") / 30).cast("int") + 1
    named = half.select(
        F.upper(F.date_format("Period", "dd-MMM-yyyy")).alias("SETTLEMENT_DATE"),
        number.alias("SETTLEMENT_PERIOD"),
        F.col("TS").alias("ND"),
        (F.col("TS") / 2).alias("ENGLAND_WALES_DEMAND"),
        F.dayofmonth("Period").alias("day"),
    )
    normal = named.filter((F.col("day") % 7 != 3) | (F.col("SETTLEMENT_PERIOD") <= 46))
    extra = named.filter((F.col("day") % 7 == 5) & (F.col("SETTLEMENT_PERIOD") >= 47)).withColumn(
        "SETTLEMENT_PERIOD", F.col("SETTLEMENT_PERIOD") + 2
    )
    return normal.unionByName(extra).drop("day")


@register("scan_ng_demand", with_sql("", "select * from demand", **STEPS))
def _(spark, sf):
    return loader.read_ng_demand(spark, as_csv(demand(spark, sf), "ng"))


@register("scan_project", with_sql("", "select SETTLEMENT_DATE, ND from demand", **STEPS))
def _(spark, sf):
    folder = as_csv(demand(spark, sf), "ng")
    return loader.read_present(
        spark, [folder, f"{folder}-not-there"], {"SETTLEMENT_DATE": "string", "ND": "double"}
    )


@register("parse_settlement_period", with_sql("", """select strptime(SETTLEMENT_DATE, '%d-%b-%Y')
    + to_minutes((SETTLEMENT_PERIOD - 1) * 30) as Period, ND, ENGLAND_WALES_DEMAND from demand
    where SETTLEMENT_PERIOD <= 48""", **STEPS))
def _(spark, sf):
    return loader.parse_settlement_period(repair.drop_long_days(demand(spark, sf)))


@register("drop_long_days", with_sql("", "select * from demand where SETTLEMENT_PERIOD <= 48", **STEPS))
def _(spark, sf):
    return repair.drop_long_days(demand(spark, sf))


@register("dst_fill_short_day", with_sql("", """select * from demand where SETTLEMENT_PERIOD <= 48 union all
    select SETTLEMENT_DATE, p, ND, ENGLAND_WALES_DEMAND from demand, (select unnest([47, 48]) as p) q
    where SETTLEMENT_PERIOD = 46 and SETTLEMENT_DATE in (select SETTLEMENT_DATE from demand group by 1
    having count(*) = 46)""", **STEPS))
def _(spark, sf):
    return repair.fix_daylight(demand(spark, sf))


# ---- zone load

LOADS = """select strftime(Period, '%m/%d/%Y %H:%M:%S') as "Time Stamp", series_id as Name, TS as "Integrated Load" from ht"""


def zone_load(spark, sf):
    return ht(spark, sf).select(
        F.date_format("Period", "MM/dd/yyyy HH:mm:ss").alias("Time Stamp"),
        F.col("series_id").alias("Name"),
        F.col("TS").alias("Integrated Load"),
    )


@register("scan_ny_load", with_sql("ht", f"select * from ({LOADS}) q"))
def _(spark, sf):
    return loader.read_ny_load(spark, as_csv(zone_load(spark, sf), "ny"), zones=True)


@register("scan_csv_paths", with_sql("ht", f"""select "Time Stamp", "Integrated Load" from ({LOADS}) q"""))
def _(spark, sf):
    rows = zone_load(spark, sf)
    first = as_csv(rows.filter(F.col("Name") != "error"), "ny")
    second = as_csv(rows.filter(F.col("Name") == "error"), "ny")
    return loader.read_ny_load(spark, [first, second])


@register("write_by_zone", with_sql("ht", f"select * from ({LOADS}) q"))
def _(spark, sf):
    folder = new_folder(spark, "zones")
    sinks.write_by_zone(zone_load(spark, sf), folder)
    return loader.read_ny_load(spark, folder, zones=True)


@register("parse_inferred_timestamp", with_sql("ht", "select series_id, Period, TS from ht"))
def _(spark, sf):
    place = F.hour("Period") % 4
    text = (
        F.when(place == 0, F.date_format("Period", "M/d/yyyy H:mm"))
        .when(place == 1, F.date_format("Period", "yyyy-MM-dd HH:mm:ss"))
        .when(place == 2, F.date_format("Period", "yyyy-MM-dd'T'HH:mm"))
        .otherwise(F.date_format("Period", "MM/dd/yyyy HH:mm:ss"))
    )
    texts = ht(spark, sf).select("series_id", text.alias("Time Stamp"), "TS")
    return loader.parse_time_stamp(texts)


# ---- stations and observations


@register("scan_stations", with_sql("st", "select USAF, LATITUDE, LONGITUDE from st"))
def _(spark, sf):
    gap = F.repeat(F.lit(" "), (F.col("USAF").cast("int") % 5 + 1))
    rows = st(spark, sf)
    line = F.concat(F.lit("  "), "USAF", gap, F.lit("99999"), gap, F.col("LATITUDE").cast("string"), F.lit(" "),
                    F.col("LONGITUDE").cast("string"), gap, F.lit("UK"))
    header = spark.range(1).select(F.lit("USAF   WBAN LATITUDE   LONGITUDE CTRY").alias("value"))
    folder = new_folder(spark, "stations")
    header.unionByName(rows.select(line.alias("value"))).write.text(folder)
    return loader.read_stations(spark, folder)


@register("scan_weather_obs", with_sql("ob_raw", """select USAF, strftime(Period, '%Y%m%d') as Date,
    cast(ord2 * 5 as varchar) as HrMn, cast(cast(Air_Temp as float) as double) as Air_Temp, RHx from ob_raw"""))
def _(spark, sf):
    raw = ob_raw(spark, sf).select(
        "USAF",
        F.date_format("Period", "yyyyMMdd").alias("Date"),
        (F.col("ord2") * 5).cast("string").alias("HrMn"),
        "W_Spd",
        "Air_Temp",
        F.col("RHx").alias("RHx "),
    )
    return loader.read_weather(spark, as_csv(raw, "obs"), ["Air_Temp", "RHx "]).withColumn(
        "Air_Temp", F.col("Air_Temp").cast("double")
    )


# ---- prepared datasets

FOLDS = """select s.series_id, cast(f.fold as int) as fold, case when s.year < y0 + f.fold + 3 then 'train' else 'test' end as role,
    count(*) as n, round(sum((TS - lo) / (hi - lo)), 4) as total from
    (select *, year(Period) as year, min(TS) over () as lo, max(TS) over () as hi, min(year(Period)) over () as y0,
    max(year(Period)) over () as y1 from d) s
    join (select unnest(generate_series(0, 20)) as fold) f on s.year between y0 + f.fold and y0 + f.fold + 3
    and y0 + f.fold + 3 <= y1 group by 1, 2, 3"""


def saved(spark, sf):
    rows = d(spark, sf)
    params = scaling.fit_scaler(rows, ["TS"], "MinMaxScaler")
    folds = splits.fold_rows(scaling.scale(rows, params, ["TS"]), (3, 1))
    folder = new_folder(spark, "dataset")
    sinks.save_dataset(folder, folds, params, {"train_test": [3, 1], "stdz": "MinMaxScaler"})
    return folder


@register("save_dataset", with_sql("d", FOLDS))
def _(spark, sf):
    folds, _, _ = sinks.load_dataset(spark, saved(spark, sf))
    return folds.all().groupBy("series_id", F.col("fold").cast("int").alias("fold"), "role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("TS"), 4).alias("total")
    )


@register("load_dataset", with_sql("d", """select s.series_id, s.Period, cast(f.fold as int) as fold,
    case when s.year < y0 + f.fold + 3 then 'train' else 'test' end as role, round(TS, 4) as TS
    from (select *, year(Period) as year, min(year(Period)) over () as y0, max(year(Period)) over () as y1 from d) s
    join (select unnest(generate_series(0, 20)) as fold) f on s.year between y0 + f.fold and y0 + f.fold + 3
    and y0 + f.fold + 3 <= y1"""))
def _(spark, sf):
    folds, params, _ = sinks.load_dataset(spark, saved(spark, sf))
    back = scaling.unscale(folds.all(), params, ["TS"])
    return back.select("series_id", "Period", F.col("fold").cast("int").alias("fold"), "role", F.round("TS", 4).alias("TS"))


VARIANT_SQL = """select variant, cast(fold as int) as fold, role, count(*) as n, features from
    (select a.*, row_number() over (order by a.Period) - 1 as idx, b.Period is not null as week_before from d a
        left join d b on b.Period = a.Period - interval 7 day) s,
    (select unnest(generate_series(0, 20)) as fold) f,
    (select 'base' as variant, 7 as skip, 3 as tr, 13 as features union all select 'no history', 0, 3, 11
     union all select 'small', 7, 2, 13) v,
    lateral (select case when y < f.fold + tr then 'train' else 'test' end as role, y from
        (select year(Period) - (select min(year(Period)) from d) as y) q) r
    where idx >= skip and (skip = 0 or week_before) and y between fold and fold + tr and fold + tr <=
    (select max(year(Period)) - min(year(Period)) from d) group by all"""


@register("dataset_variants", with_sql("d", VARIANT_SQL))
def _(spark, sf):
    from gridseries.operators.timegrid import row_index
    from gridseries.plans.forecaster import LoadForecaster, dataset_variants

    forecaster = LoadForecaster(spark)
    forecaster.override("data", location="NYC")
    forecaster.override("features", points=["7r"], averages=["7d"], train_test=(3, 1), stdz="MinMaxScaler")
    forecaster.clean_load = row_index(d(spark, sf))
    variants = {
        "base": {},
        "no history": {"features": {"points": [], "averages": []}},
        "small": {"features": {"train_test": (2, 1)}},
    }
    out = None
    for name, folder in dataset_variants(forecaster, new_folder(spark, "variants"), variants).items():
        folds, _, _ = sinks.load_dataset(spark, folder)
        width = len(set(folds.rows.columns) - {"series_id", "Period", "TS", splits.YEAR})
        part = folds.all().groupBy(F.col("fold").cast("int").alias("fold"), "role").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("variant"), "fold", "role", "n", F.lit(width).alias("features")
        )
        out = part if out is None else out.unionByName(part)
    return out
