"""Queries on weather observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.catalog.fixtures import d, ob, ob_raw, st, with_sql
from gridseries.catalog.registry import registry
from gridseries.functions import clock
from gridseries.operators import evaluate, quality, stations, weather
from gridseries.session import materialise

QUERIES, register = registry()
VARIABLES = ["W_Spd", "Air_Temp", "RHx"]


def rounded(df, *columns):
    """Six decimals. Means of decimal readings often end in a 5 there, so both sides step off that tie first."""
    return df.withColumns({c: F.round(F.col(c) + 3e-9, 6) for c in columns})


def clustered(spark, sf):
    """Stations dealt to eight clusters by number."""
    return st(spark, sf).withColumn("cluster_num", (F.col("USAF").cast("int") % 8).cast("int"))


CL = "select *, cast(cast(USAF as int) % 8 as int) as cluster_num from st"


@register("parse_date_hrmn", with_sql("ob_raw", """select USAF, ord1, ord2, Period + to_minutes(cast(60 * (ord1 % 24)
    + (ord2 * 7) % 60 as int)) as Period from ob_raw"""))
def _(spark, sf):
    hhmm = ((F.col("ord1") % 24) * 100 + (F.col("ord2") * 7) % 60).cast("string")
    text = ob_raw(spark, sf).select(
        "USAF", "ord1", "ord2", F.date_format("Period", "yyyyMMdd").alias("Date"), hhmm.alias("HrMn")
    )
    return weather.parse_date_hrmn(text)


LIMITS = ", ".join(
    f"quantile_cont({v}, 0.99) as {v}_h, quantile_cont({v}, 1 - 0.99) as {v}_l" for v in VARIABLES
)
CLEAN = "select USAF, Period, " + ", ".join(
    f"case when {v} > {v}_h * 1.3 or {v} < {v}_l / 1.3 then null else {v} end as {v}" for v in VARIABLES
) + f" from ob, (select {LIMITS} from ob) q"


@register("null_out_extremes", with_sql("ob", "select * from clean", clean=CLEAN))
def _(spark, sf):
    return weather.null_out_extremes(materialise(ob(spark, sf), "readings"), VARIABLES)


@register("gap_lengths", with_sql("ob", """select USAF, Period, cast(epoch(Period - lag(Period) over
    (partition by USAF order by Period)) as bigint) as step from ob"""))
def _(spark, sf):
    return quality.gap_lengths(ob(spark, sf).select("USAF", "Period"), ["USAF"])


AVAIL = """select USAF, round(count(*) filter (step <= 2 * 86400) * 100.0 / count(*) + 3e-9, 6) as availability
    from (select USAF, epoch(Period - lag(Period) over (partition by USAF order by Period)) as step from ob) q group by 1"""


@register("availability_pct", with_sql("ob", AVAIL))
def _(spark, sf):
    return rounded(quality.availability(ob(spark, sf), 2 * clock.DAY), "availability")


@register("semi_good_stations", with_sql("st ob", """select o.USAF, count(*) as n from ob o
    where o.USAF in (select USAF from avail where availability > 37.5) group by 1""", avail=AVAIL))
def _(spark, sf):
    _, kept = stations.filter_stations(st(spark, sf), ob(spark, sf), quality=("2 days", 37.5))
    return kept.groupBy("USAF").agg(F.count(F.lit(1)).alias("n"))


@register("semi_stations_with_data", with_sql("st ob", """select * from st
    where USAF in (select USAF from ob)"""))
def _(spark, sf):
    return stations.with_data(st(spark, sf), ob(spark, sf))


@register("join_station_cluster", with_sql("st ob", """select USAF, Period, W_Spd, cluster_num from ob join cl using (USAF)""",
    cl=CL))
def _(spark, sf):
    return weather.with_cluster(ob(spark, sf).select("USAF", "Period", "W_Spd"), clustered(spark, sf))


MEANS = """select Period, cluster_num, avg(W_Spd) as W_Spd, avg(Air_Temp) as Air_Temp, avg(RHx) as RHx
    from {src} join cl using (USAF) group by 1, 2"""


@register("cluster_mean", with_sql("st ob", """select Period, cluster_num, round(W_Spd + 3e-9, 6) as W_Spd,
    round(Air_Temp + 3e-9, 6) as Air_Temp, round(RHx + 3e-9, 6) as RHx from means""", cl=CL, means=MEANS.format(src="ob")))
def _(spark, sf):
    joined = weather.with_cluster(ob(spark, sf), clustered(spark, sf))
    return rounded(weather.cluster_means(joined, VARIABLES), *VARIABLES)


@register("pivot_station", with_sql("st ob", "select Period, " + ", ".join(
    f"round(max(case when cluster_num = {k} then Air_Temp end) + 3e-9, 6) as c{k}" for k in range(8))
    + " from means group by 1", cl=CL, means=MEANS.format(src="ob")))
def _(spark, sf):
    """Every cluster's mean as a station of its own, one column each."""
    joined = weather.with_cluster(ob(spark, sf), clustered(spark, sf))
    means = weather.cluster_means(joined, ["Air_Temp"])
    named = means.select("Period", F.concat(F.lit("c"), "cluster_num").alias("USAF"), "Air_Temp")
    names = [f"c{k}" for k in range(8)]
    return rounded(weather.pivot_station(named, "Air_Temp", names), *names)


@register("join_load_weather", with_sql("d st ob", "select d.*, " + ", ".join(
    f"round(W_Spd_{k} + 3e-9, 6) as W_Spd_{k}" for k in range(8)) + " from d left join (select Period, " + ", ".join(
    f"max(case when cluster_num = {k} then W_Spd end) as W_Spd_{k}" for k in range(8))
    + " from means group by 1) w on w.Period = d.Period", cl=CL, means=MEANS.format(src="ob")))
def _(spark, sf):
    joined = weather.with_cluster(ob(spark, sf), clustered(spark, sf))
    long = weather.to_long(weather.cluster_means(joined, ["W_Spd"]), ["W_Spd"])
    wide = weather.pivot_clusters(long, [("W_Spd", k) for k in range(8)])
    return rounded(weather.join_weather(d(spark, sf), wide), *[f"W_Spd_{k}" for k in range(8)])


@register("station_mean", with_sql("st ob", """select month, round(q1 + 3e-9, 6) as q1, round(median + 3e-9, 6) as median,
    round(q3 + 3e-9, 6) as q3, round(min(TS) filter (TS >= q1 - 1.5 * (q3 - q1) and TS <= q3 + 1.5 * (q3 - q1)) + 3e-9, 6) as whisker_low,
    round(max(TS) filter (TS >= q1 - 1.5 * (q3 - q1) and TS <= q3 + 1.5 * (q3 - q1)) + 3e-9, 6) as whisker_high
    from (select month, TS, quantile_cont(TS, 0.25) over w as q1, median(TS) over w as median,
    quantile_cont(TS, 0.75) over w as q3 from (select cast(month(Period) as int) as month, avg(Air_Temp) as TS
    from means group by Period) a window w as (partition by month)) b group by month, q1, median, q3""",
    cl=CL, means=MEANS.format(src="ob")))
def _(spark, sf):
    joined = weather.with_cluster(ob(spark, sf), clustered(spark, sf))
    long = weather.to_long(weather.cluster_means(joined, ["Air_Temp"]), ["Air_Temp"])
    monthly = materialise(weather.station_mean(long), "station-mean").withColumn("month", F.month("Period"))
    box = evaluate.box_stats(monthly, "TS", ["month"], outliers=False)
    return rounded(box, "q1", "median", "q3", "whisker_low", "whisker_high")


LONG = """select 'W_Spd' as var, cluster_num, Period, W_Spd as TS from means
    union all select 'Air_Temp', cluster_num, Period, Air_Temp from means
    union all select 'RHx', cluster_num, Period, RHx from means"""


def long_means(spark, sf):
    known = clustered(spark, sf)
    readings = materialise(ob(spark, sf), "readings")
    return materialise(weather.preprocess(readings, known, VARIABLES), "cluster-means")


def grid_sql(step, span, keys, rows):
    """Grid of `step` over the common span of all series, with positions and the known values around."""
    return f"""select k.var, k.cluster_num, g.Period, t.TS, row_number() over
        (partition by k.var, k.cluster_num order by g.Period) - 1 as idx
        from (select distinct var, cluster_num from {keys}) k,
        (select unnest(generate_series(min(Period), max(Period), interval {step})) as Period from {span}) g
        left join {rows} t on t.var = k.var and t.cluster_num = k.cluster_num and t.Period = g.Period"""


def fill_sql(grid, condition):
    return f"""select g.var, g.cluster_num, g.Period, g.idx, case when g.TS is null and pi is not null and ni is not null
        and {condition} then p.TS + (n.TS - p.TS) * (g.idx - pi) / (ni - pi) else g.TS end as TS
        from (select *, max(case when TS is not null then idx end) over (partition by var, cluster_num order by idx
        rows between unbounded preceding and 1 preceding) as pi, min(case when TS is not null then idx end) over
        (partition by var, cluster_num order by idx rows between 1 following and unbounded following) as ni from {grid}) g
        left join {grid} p on p.var = g.var and p.cluster_num = g.cluster_num and p.idx = g.pi
        left join {grid} n on n.var = g.var and n.cluster_num = g.cluster_num and n.idx = g.ni"""


CHAIN = {
    "cl": CL,
    "clean": CLEAN,
    "means": MEANS.format(src="clean"),
    "long": LONG,
    "fine": grid_sql("12 hours", "long", "long", "long"),
    "fine_filled": fill_sql("fine", "g.idx - pi <= 3"),
    "coarse": grid_sql("1 day", "fine_filled", "fine_filled", "fine_filled"),
    "dense": """select * from coarse where (var, cluster_num) in (select (var, cluster_num) from coarse
        group by var, cluster_num having avg(case when TS is null then 1.0 else 0.0 end) * 100 <= 100 - {quality})""",
    "short_filled": fill_sql("dense", "ni - pi - 1 <= 1"),
}


def chain(quality):
    return CHAIN | {"dense": CHAIN["dense"].format(quality=quality)}


@register("weather_clean", with_sql("st ob", """select var, cluster_num, Period, round(coalesce(TS, avg(TS) over
    (partition by var, cluster_num, year(Period), month(Period), hour(Period))) + 3e-9, 6) as TS from short_filled""", **chain(50)))
def _(spark, sf):
    long = long_means(spark, sf)
    out = weather.postprocess(long, clock.DAY, 50.0, fine_step=clock.DAY // 2, limit=3, short_gap=1)
    return rounded(out.select("var", "cluster_num", "Period", "TS"), "TS")


@register("drop_sparse_groups", with_sql("st ob", "select var, cluster_num, count(*) as n from dense group by 1, 2",
    **{k: v for k, v in chain(96.05).items() if not k.startswith("short")}))
def _(spark, sf):
    coarse = materialise(weather.resample(long_means(spark, sf), clock.DAY, clock.DAY // 2, 3), "resampled")
    dense = quality.drop_sparse(coarse, 96.05, weather.CLUSTER_SERIES)
    return dense.groupBy(*weather.CLUSTER_SERIES).agg(F.count(F.lit(1)).alias("n"))
