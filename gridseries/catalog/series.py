"""Queries on load series: cleaning, detection, repair, gaps, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.catalog.fixtures import d, h, ht, hz, with_sql
from gridseries.catalog.registry import registry, rounded
from gridseries.functions import clock
from gridseries.operators import evaluate, features, quality, repair, timegrid

QUERIES, register = registry()


# ---- projections and filters


@register("to_std_fields", with_sql("h", "select series_id, Period, TS from h where year(Period) in (2024, 2025)"))
def _(spark, sf):
    renamed = h(spark, sf).withColumnRenamed("TS", "ND")
    return features.to_std_fields(renamed, "ND", [2024, 2025])


@register("filter_years", with_sql("d", "select series_id, Period, TS from d where year(Period) in (1996, 1998)"))
def _(spark, sf):
    return features.filter_years(d(spark, sf), [1996, 1998, 2050])


@register("intersect_years", with_sql("d", """select distinct cast(year(Period) as int) as year from d
    where year(Period) in (1996, 1998, 2050)"""))
def _(spark, sf):
    asked = spark.sql("select explode(array(1996, 1998, 2050)) as year")
    return features.distinct_years(d(spark, sf)).select("year").intersect(asked)


@register("distinct_years", with_sql("d", "select distinct series_id, cast(year(Period) as int) as year from d"))
def _(spark, sf):
    return features.distinct_years(d(spark, sf))


@register("except_keys", with_sql("d", """select distinct cast(year(Period) as int) as year from d
    where year(Period) not in (1996, 1998)"""))
def _(spark, sf):
    handled = spark.sql("select explode(array(1996, 1998)) as year")
    return features.distinct_years(d(spark, sf)).select("year").exceptAll(handled)


HOURS_SQL = """select k.series_id, k.Period, t.TS from (select s.series_id, s.lo + to_hours(cast(g.i as int)) as Period
    from (select series_id, min(Period) as lo, date_diff('hour', min(Period), max(Period)) as n from ht group by 1) s,
    lateral (select unnest(generate_series(0, s.n)) as i) g) k
    left join ht t on t.series_id = k.series_id and t.Period = k.Period"""


def hourly_grid(spark, sf):
    return timegrid.regrid(ht(spark, sf), clock.HOUR)


@register("fill_null_zero", with_sql("ht", "select series_id, Period, coalesce(TS, 0.0) as TS from grid", grid=HOURS_SQL))
def _(spark, sf):
    return repair.fill_null_zero(hourly_grid(spark, sf)).select("series_id", "Period", "TS")


@register("sort_period", with_sql("h", "select series_id, Period, TS from h order by series_id, Period"))
def _(spark, sf):
    return h(spark, sf).orderBy("series_id", "Period")


@register("union_files", with_sql("h ht", "select * from h union all select * from ht"))
def _(spark, sf):
    return h(spark, sf).unionByName(ht(spark, sf))


@register("load_mode", with_sql("h ht", """select 'append' as mode, * from h union all select 'append', * from ht
    union all select 'replace', * from h"""))
def _(spark, sf):
    from gridseries.sources.loader import combine

    old, new = ht(spark, sf), h(spark, sf)
    appended = combine(old, new, "append").select(F.lit("append").alias("mode"), "*")
    replaced = combine(old, new, "replace").select(F.lit("replace").alias("mode"), "*")
    return appended.unionByName(replaced)


# ---- quantiles and grouped statistics


@register("quantiles_global", with_sql("h", """select series_id, round(quantile_cont(TS, 0.01), 6) as low,
    round(quantile_cont(TS, 0.99), 6) as high from h group by 1"""))
def _(spark, sf):
    return rounded(quality.quantile_limits(h(spark, sf), 0.99, ["series_id"]), "low", "high")


@register("quantiles_hourly", with_sql("h", """select series_id, cast(hour(Period) as int) as hour,
    round(quantile_cont(TS, 0.01), 6) as low, round(quantile_cont(TS, 0.99), 6) as high from h group by 1, 2"""))
def _(spark, sf):
    hourly = h(spark, sf).withColumn("hour", F.hour("Period"))
    return rounded(quality.quantile_limits(hourly, 0.99, ["series_id", "hour"]), "low", "high")


@register("join_hour_stats", with_sql("h", """select series_id, Period, TS, cast(hour(Period) as int) as hour,
    round(quantile_cont(TS, 0.01) over (partition by series_id, hour(Period)), 6) as low,
    round(quantile_cont(TS, 0.99) over (partition by series_id, hour(Period)), 6) as high from h"""))
def _(spark, sf):
    return rounded(quality.join_hour_limits(h(spark, sf), 0.99), "low", "high")


@register("daily_mean", with_sql("h", """select series_id, cast(Period as date) as day, round(avg(TS), 6) as mean
    from h group by 1, 2"""))
def _(spark, sf):
    return rounded(features.daily_mean(h(spark, sf)), "mean")


@register("join_day_offset", with_sql("h", """select a.series_id, a.Period, a.TS, round(b.mean, 6) as mean_before
    from h a left join (select series_id, cast(Period as date) as day, avg(TS) as mean from h group by 1, 2) b
    on a.series_id = b.series_id and cast(a.Period as date) = b.day + 3"""))
def _(spark, sf):
    return rounded(features.join_day_offset(h(spark, sf), 3, "mean_before"), "mean_before")


@register("month_hour_climatology", with_sql("ht", """select series_id, cast(year(Period) as int) as year,
    cast(month(Period) as int) as month, cast(hour(Period) as int) as hour, round(avg(TS), 6) as mean
    from ht group by 1, 2, 3, 4"""))
def _(spark, sf):
    return rounded(repair.month_hour_means(ht(spark, sf)), "mean")


@register("join_month_hour_mean", with_sql("ht", """select series_id, Period, TS, round(avg(TS) over
    (partition by series_id, year(Period), month(Period), hour(Period)), 6) as mean from ht"""))
def _(spark, sf):
    return rounded(repair.join_month_hour_mean(ht(spark, sf)), "mean")


@register("null_share", with_sql("ht", """select series_id, round(avg(case when TS is null then 1.0 else 0.0 end) * 100, 6)
    as null_pct from grid group by 1""", grid=HOURS_SQL))
def _(spark, sf):
    return rounded(quality.null_share(hourly_grid(spark, sf), ["series_id"]), "null_pct")


@register("modal_step", with_sql("ht", """select series_id, step, n from (select *, row_number() over
    (partition by series_id order by n desc, step) as rk from (select series_id, step, count(*) as n from
    (select series_id, cast(epoch(Period - lag(Period) over (partition by series_id order by Period)) as bigint)
    as step from ht) a where step is not null group by 1, 2) b) c where rk = 1"""))
def _(spark, sf):
    return quality.modal_step(ht(spark, sf))


@register("short_days", with_sql("ht", """select series_id, cast(Period as date) as day, count(*) as n from ht
    group by 1, 2 having count(*) = 23"""))
def _(spark, sf):
    dated = ht(spark, sf).withColumn("day", F.to_date("Period"))
    return repair.short_days(dated, "day", 23, by=["series_id"])


# ---- duplicates

DOUBLED_SQL = """select series_id, Period, TS, 0 as ord from ht
    union all select series_id, Period, case when hour(Period) % 3 = 0 then 0.0 else TS * 2 end, 1 from ht
    where hour(Period) % 2 = 0
    union all select series_id, Period, 0.0, 2 from ht where hour(Period) % 4 = 1"""


def doubled(spark, sf):
    one = ht(spark, sf).withColumn("ord", F.lit(0))
    hour = F.hour("Period")
    two = one.filter(hour % 2 == 0).withColumns(
        {"TS": F.when(hour % 3 == 0, 0.0).otherwise(F.col("TS") * 2), "ord": F.lit(1)}
    )
    three = one.filter(hour % 4 == 1).withColumns({"TS": F.lit(0.0), "ord": F.lit(2)})
    return one.unionByName(two).unionByName(three)


@register("merge_duplicates", with_sql("ht", """select series_id, Period,
    round(coalesce(avg(nullif(TS, 0)), 0.0), 6) as TS from doubled group by 1, 2""", doubled=DOUBLED_SQL))
def _(spark, sf):
    return rounded(repair.merge_duplicates(doubled(spark, sf)), "TS")


@register("keep_last_duplicate", with_sql("ht", """select series_id, Period, max_by(TS, ord) as TS
    from doubled group by 1, 2""", doubled=DOUBLED_SQL))
def _(spark, sf):
    return repair.keep_last_duplicate(doubled(spark, sf), "ord")


@register("keep_first_duplicate", with_sql("ob", "select * from ob"))
def _(spark, sf):
    from gridseries.catalog.fixtures import ob

    return ob(spark, sf)


# ---- detectors

LIMITS = """select series_id, quantile_cont(TS, 1 - 0.99) as low, quantile_cont(TS, 0.99) as high from {src} group by 1"""
CHANGE = """case when TS = 0 and {o} <> 0 then cast('inf' as double) when TS = 0 or {o} is null then null
    else abs((TS - {o}) / TS) end"""


def zeros_sql(src):
    return f"select *, TS = 0 as bad from {src}"


def extremes_sql(src):
    return f"""select a.*, TS > high * 1.5 or TS < low / 1.5 as bad from {src} a
        join ({LIMITS.format(src=src)}) l on a.series_id = l.series_id"""


def hourly_sql(src):
    return f"""select series_id, Period, idx, TS, TS > high * 1.5 or TS < low / 1.5 as bad from (select *,
        quantile_cont(TS, 1 - 0.99) over (partition by series_id, hour(Period)) as low,
        quantile_cont(TS, 0.99) over (partition by series_id, hour(Period)) as high from {src}) q"""


def derivatives_sql(src, factor=1.5, q=0.99):
    changes = f"""select *, {CHANGE.format(o='before')} as db, {CHANGE.format(o='after')} as da from (select *,
        lag(TS) over w as before, lead(TS) over w as after from {src}
        window w as (partition by series_id order by idx)) q"""
    return f"""select c.series_id, Period, idx, TS, coalesce(db > qb * {factor} and da > qa * {factor}, false) as bad
        from ({changes}) c join (select series_id, quantile_cont(db, {q}) as qb, quantile_cont(da, {q}) as qa
        from ({changes}) e group by 1) l on c.series_id = l.series_id"""


def repair_sql(flagged, width=3, null_them=False):
    """One repair pass over `flagged` (series_id, Period, idx, TS, bad)."""
    if null_them:
        value, fits = "null", f"coalesce(ni, mi + 1) - coalesce(pi, -1) - 1 <= {width}"
    else:
        value = "p.TS + (n.TS - p.TS) * (g.idx - pi) / (ni - pi)"
        fits = f"pi is not null and ni is not null and ni - pi - 1 <= {width}"
    return f"""select g.series_id, g.Period, g.idx, g.bad, g.bad and {fits} as repaired,
        case when g.bad and {fits} then {value} else g.TS end as TS
        from (select *, max(case when not bad then idx end) over (partition by series_id order by idx
                rows between unbounded preceding and 1 preceding) as pi,
            min(case when not bad then idx end) over (partition by series_id order by idx
                rows between 1 following and unbounded following) as ni,
            max(idx) over (partition by series_id) as mi from {flagged}) g
        left join {flagged} p on p.series_id = g.series_id and p.idx = g.pi
        left join {flagged} n on n.series_id = g.series_id and n.idx = g.ni"""


def hits(df):
    return df.filter("bad").select("series_id", "Period", "idx", "TS")


HITS = "select series_id, Period, idx, TS from flagged where bad"


@register("detect_zeros", with_sql("hz", HITS, flagged=zeros_sql("hz")))
def _(spark, sf):
    return hits(quality.flag_zeros(hz(spark, sf)))


@register("detect_extremes_global", with_sql("hz", HITS, flagged=extremes_sql("hz")))
def _(spark, sf):
    return hits(quality.flag_extremes(hz(spark, sf)))


@register("detect_extremes_hourly", with_sql("hz", HITS, flagged=hourly_sql("hz")))
def _(spark, sf):
    return hits(quality.flag_extremes_hourly(hz(spark, sf)))


@register("detect_derivatives", with_sql("hz", HITS, flagged=derivatives_sql("hz", 1.0, 0.9)))
def _(spark, sf):
    return hits(quality.flag_derivatives(hz(spark, sf), (1.0, 0.9)))


@register("runs", with_sql("hz", """select series_id, idx - rk as run_id, min(idx) as start_idx, max(idx) as end_idx,
    count(*) as len from (select *, row_number() over (partition by series_id order by idx) - 1 as rk
    from flagged where bad) q group by 1, 2""", flagged=zeros_sql("hz")))
def _(spark, sf):
    flagged = quality.flag_zeros(hz(spark, sf))
    return timegrid.runs(flagged, F.col("bad"))


@register("repair_interpolate", with_sql("hz", """select series_id, Period, idx, round(TS, 6) as TS, repaired from fixed""",
    flagged=zeros_sql("hz"), fixed=repair_sql("flagged")))
def _(spark, sf):
    fixed = repair.repair(quality.flag_zeros(hz(spark, sf)))
    return rounded(fixed, "TS").drop("bad")


@register("repair_null", with_sql("hz", """select series_id, Period, idx, round(TS, 6) as TS, repaired from fixed""",
    flagged=zeros_sql("hz"), fixed=repair_sql("flagged", null_them=True)))
def _(spark, sf):
    fixed = repair.repair(quality.flag_zeros(hz(spark, sf)), strategy="nan")
    return rounded(fixed, "TS").drop("bad")


STAGE_SQL = {
    "zeros": zeros_sql,
    "extremes_hourly": hourly_sql,
    "extremes_global": extremes_sql,
    "derivatives": derivatives_sql,
}


def fix_sql(kinds):
    """Named steps of a repair sequence: `flag_<kind>`, `fix_<kind>` and the series after it."""
    steps, series = {}, "hz"
    for kind in kinds:
        steps[f"flag_{kind}"] = STAGE_SQL[kind](series)
        steps[f"fix_{kind}"] = repair_sql(f"flag_{kind}")
        series = f"after_{kind}"
        steps[series] = f"select series_id, Period, idx, TS from fix_{kind}"
    return steps


ALL_FIXES = ("zeros", "extremes_hourly", "extremes_global", "derivatives")


@register("fix_data", with_sql("hz", """select a.series_id, a.Period, a.idx, round(d.TS, 6) as TS, a.bad as zeros,
    b.bad as extremes_hourly, c.bad as extremes_global, d.bad as derivatives,
    (a.bad and not a.repaired) or (b.bad and not b.repaired) or (c.bad and not c.repaired)
    or (d.bad and not d.repaired) as refused
    from fix_zeros a join fix_extremes_hourly b using (series_id, idx)
    join fix_extremes_global c using (series_id, idx) join fix_derivatives d using (series_id, idx)""",
    **fix_sql(ALL_FIXES)))
def _(spark, sf):
    return rounded(repair.fix_data(hz(spark, sf), ALL_FIXES), "TS")


DEFAULT_FIXES = ("zeros", "extremes_global", "derivatives")


@register("error_counts", with_sql("hz", """select *, zeros + extremes_global + derivatives as total from (select
    (select count(*) from flag_zeros where bad) as zeros,
    (select count(*) from flag_extremes_global where bad) as extremes_global,
    (select count(*) from flag_derivatives where bad) as derivatives) q""", **fix_sql(DEFAULT_FIXES)))
def _(spark, sf):
    return quality.error_counts(repair.fix_data(hz(spark, sf), DEFAULT_FIXES))


@register("window_around_event", with_sql("hz", """select e.series_id, e.Period as event_period, r.Period, r.idx, r.TS
    from hz r join (select * from hz where TS = 0) e on r.series_id = e.series_id
    and r.Period between e.Period - interval 1 day and e.Period + interval 1 day"""))
def _(spark, sf):
    series = hz(spark, sf)
    return evaluate.around_events(series, hits(quality.flag_zeros(series)))


# ---- gaps


@register("regrid", with_sql("ht", "select series_id, Period, TS from grid", grid=HOURS_SQL))
def _(spark, sf):
    return hourly_grid(spark, sf).select("series_id", "Period", "TS")


GRID_STEPS = {
    "grid": HOURS_SQL,
    "gi": "select *, row_number() over (partition by series_id order by Period) - 1 as idx from grid",
    "near": """select *, max(case when TS is not null then idx end) over (partition by series_id order by idx
        rows between unbounded preceding and 1 preceding) as pi, min(case when TS is not null then idx end) over
        (partition by series_id order by idx rows between 1 following and unbounded following) as ni from gi""",
}


def gap_fill_sql(condition):
    return f"""select g.series_id, g.Period, g.idx, case when g.TS is null and pi is not null and ni is not null
        and {condition} then p.TS + (n.TS - p.TS) * (g.idx - pi) / (ni - pi) else g.TS end as TS
        from near g left join gi p on p.series_id = g.series_id and p.idx = g.pi
        left join gi n on n.series_id = g.series_id and n.idx = g.ni"""


@register("interpolate_limited", with_sql("ht", "select series_id, Period, idx, round(TS, 6) as TS from filled",
    **GRID_STEPS, filled=gap_fill_sql("g.idx - pi <= 2")))
def _(spark, sf):
    return rounded(repair.interpolate_limited(hourly_grid(spark, sf), 2), "TS")


@register("fill_short_gaps", with_sql("ht", "select series_id, Period, idx, round(TS, 6) as TS from filled",
    **GRID_STEPS, filled=gap_fill_sql("ni - pi - 1 <= 2")))
def _(spark, sf):
    return rounded(repair.fill_short_gaps(hourly_grid(spark, sf), 2), "TS")


@register("fill_climatology", with_sql("ht", """select series_id, Period, idx, round(coalesce(TS, avg(TS) over
    (partition by series_id, year(Period), month(Period), hour(Period))), 6) as TS from filled""",
    **GRID_STEPS, filled=gap_fill_sql("ni - pi - 1 <= 1")))
def _(spark, sf):
    short = repair.fill_short_gaps(hourly_grid(spark, sf), 1)
    return rounded(repair.fill_climatology(short), "TS")


# ---- the minimum forecast


@register("day_ahead_mape", with_sql("hz", """select cast(Period as date) as day,
    round(avg(abs((TS - forecast) / nullif(TS, 0))) * 100, 6) as MAPE from
    (select *, lag(TS, 24) over (partition by series_id order by idx) as forecast from fix_extremes_global) q
    where forecast is not null group by 1""", **fix_sql(("zeros", "extremes_global"))))
def _(spark, sf):
    fixed = repair.fix_data(hz(spark, sf), ("zeros", "extremes_global"))
    lagged = features.add_lags(fixed.select("series_id", "Period", "idx", "TS"), ["24r"], 1)
    scored = lagged.filter(F.col("Previous_24").isNotNull()).select(
        F.to_date("Period").alias("day"), F.col("TS").alias("actual"), F.col("Previous_24").alias("forecast")
    )
    return scored.groupBy("day").agg(F.round(evaluate.metric("MAPE"), 6).alias("MAPE"))
