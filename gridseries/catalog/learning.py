"""Queries on features, scalers, folds, forecasts and their errors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridseries.catalog.fixtures import d, h, ht, pf, with_sql
from gridseries.catalog.registry import registry, rounded
from gridseries.functions import clock
from gridseries.operators import evaluate, features, forecast, linear, scaling, splits, timegrid
from gridseries.operators.quantiles import attach
from gridseries.session import materialise

QUERIES, register = registry()


def hi(spark, sf):
    return timegrid.row_index(h(spark, sf))


def di(spark, sf):
    return timegrid.row_index(d(spark, sf))


DI = "select *, row_number() over (partition by series_id order by Period) - 1 as idx from d"

# ---- past load

LAGS_SQL = """select *, lag(TS, 1) over w as Previous_1, lag(TS, 2) over w as Previous_2, lag(TS, 24) over w as Previous_24,
    lag(TS, 168) over w as Previous_168 from hi window w as (partition by series_id order by idx)"""


@register("lag_features", with_sql("hi", "select * from lags", lags=LAGS_SQL))
def _(spark, sf):
    return features.add_lags(hi(spark, sf), ["1-2h", "24r", "7d", "3x"], 1)


AVG_SQL = """select a.series_id, a.Period, a.TS, round(b.m, 6) as Avg_1, round(c.m, 6) as Avg_7 from h a
    left join days b on a.series_id = b.series_id and cast(a.Period as date) = b.day + 1
    left join days c on a.series_id = c.series_id and cast(a.Period as date) = c.day + 7"""
DAYS_SQL = "select series_id, cast(Period as date) as day, avg(TS) as m from h group by 1, 2"


@register("prev_day_mean", with_sql("h", AVG_SQL, days=DAYS_SQL))
def _(spark, sf):
    return rounded(features.add_day_means(h(spark, sf), ["1d", "7d", "2h"]), "Avg_1", "Avg_7")


@register("drop_incomplete_rows", with_sql("hi", """select * from lags where Previous_1 is not null
    and Previous_2 is not null and Previous_24 is not null and Previous_168 is not null""", lags=LAGS_SQL))
def _(spark, sf):
    return features.add_historical_ts(hi(spark, sf), ["1-2h", "1d", "7d"])


@register("difference", with_sql("h", """select series_id, Period, round(TS - p, 6) as TS, start from (select *,
    lag(TS) over (partition by series_id order by Period) as p,
    first_value(TS) over (partition by series_id order by Period) as start from h) q where p is not null"""))
def _(spark, sf):
    return rounded(features.difference(h(spark, sf)), "TS")


@register("undifference", with_sql("h", """select series_id, Period, round(TS, 4) as TS from (select *, row_number() over
    (partition by series_id order by Period) as rn from h) q where rn > 1"""))
def _(spark, sf):
    back = features.undifference(features.difference(h(spark, sf)))
    return back.select("series_id", "Period", F.round("TS", 4).alias("TS"))


@register("pct_change", with_sql("h", """select series_id, Period, TS, round((TS / lag(TS) over
    (partition by series_id order by Period) - 1) * 100, 6) as pct_change from h"""))
def _(spark, sf):
    return rounded(features.pct_change(h(spark, sf)), "pct_change")


# ---- calendar


@register("date_parts", with_sql("h", """select series_id, Period, TS, cast(year(Period) as int) as Year,
    cast(day(Period) as int) as Day, cast(isodow(Period) - 1 as int) as DoW, cast(dayofyear(Period) as int) as DoY,
    cast(month(Period) as int) as Month, cast(hour(Period) as int) as Hour, cast(minute(Period) as int) as Minute from h"""))
def _(spark, sf):
    return features.encode_time(h(spark, sf), "categorical")


def _turn(name, turn):
    return f"round(sin(2 * pi() * {turn}), 6) + 0 as sin_{name}, round(cos(2 * pi() * {turn}), 6) + 0 as cos_{name}"


@register("cyclical_time", with_sql("h", "select series_id, Period, TS, cast(year(Period) as int) as Year, " + ", ".join([
    _turn("hour", "(hour(Period) * 3600 + minute(Period) * 60) / 86400.0"),
    _turn("day_in_month", "day(Period) / day(last_day(cast(Period as date)))"),
    _turn("day_in_week", "(isodow(Period) - 1) / 7.0"),
    _turn("day_in_year", "dayofyear(Period) / 365.0"),
    _turn("month", "month(Period) / 12.0"),
]) + " from h"))
def _(spark, sf):
    encoded = features.encode_time(h(spark, sf), "cyclical")
    turns = [c for c in encoded.columns if c.startswith(("sin_", "cos_"))]
    return encoded.withColumns({c: F.round(c, 6) + 0 for c in turns})


@register("iso_week", with_sql("d", """select Period, cast(year(Period) as int) as year,
    cast(weekofyear(Period) as int) as week from d"""))
def _(spark, sf):
    return d(spark, sf).select("Period", F.year("Period").alias("year"), clock.iso_week(F.col("Period")).alias("week"))


@register("season", with_sql("d", """select Period, case when month(Period) in (12, 1, 2) then 'Winter'
    when month(Period) in (3, 4, 5) then 'Spring' when month(Period) in (6, 7, 8) then 'Summer' else 'Fall' end as season
    from d"""))
def _(spark, sf):
    return d(spark, sf).select("Period", clock.season(F.col("Period")).alias("season"))


@register("time_of_day", with_sql("h", "select Period, strftime(Period, '%H:%M:%S') as time_of_day from h"))
def _(spark, sf):
    return h(spark, sf).select("Period", clock.clock_time(F.col("Period")).alias("time_of_day"))


@register("math_ops", with_sql("h", """select Period, abs(TS - 500) as dist, round(sqrt(TS), 6) as root,
    round(TS / 7, 2) as part, case when TS > 500 then 'high' else 'low' end as level,
    case when hour(Period) = 0 then null else round(TS / hour(Period), 6) end as per_hour from h"""))
def _(spark, sf):
    ts = F.col("TS")
    return h(spark, sf).select(
        "Period",
        F.abs(ts - 500).alias("dist"),
        F.round(F.sqrt(ts), 6).alias("root"),
        F.round(ts / 7, 2).alias("part"),
        F.when(ts > 500, "high").otherwise("low").alias("level"),
        F.round(F.try_divide(ts, F.hour("Period")), 6).alias("per_hour"),
    )


# ---- encoding and selection

ONE_HOT_SQL = ", ".join(
    [f"cast(isodow(Period) - 1 = {v} as int) as DoW_{v}" for v in range(1, 7)]
    + [f"cast(hour(Period) = {v} as int) as Hour_{v}" for v in range(1, 24)]
)


def encoded(spark, sf):
    parts = {k: v for k, v in clock.calendar_parts(F.col("Period")).items() if k in ("DoW", "Hour", "Year")}
    return features.encode_vars(h(spark, sf).withColumns(parts))


@register("one_hot", with_sql("h", f"select series_id, Period, TS, cast(year(Period) as int) as Year, {ONE_HOT_SQL} from h"))
def _(spark, sf):
    return encoded(spark, sf)


@register("select_features", with_sql("h", f"select cast(year(Period) as int) as Year, {ONE_HOT_SQL} from h"))
def _(spark, sf):
    table = encoded(spark, sf)
    return table.select(features.select_features(table, ["TS"], ["series_id", "Period"]))


@register("select_by_prefix", with_sql("h", "select Period, " + ", ".join(
    f"cast(hour(Period) = {v} as int) as Hour_{v}" for v in range(1, 24)) + ", 6 as dow_columns from h"))
def _(spark, sf):
    table = encoded(spark, sf)
    hours = features.select_by_prefix(table.columns, ["Hour_1"])
    counted = features.count_by_variable(table.columns, ["DoW"])
    return table.select("Period", *hours, F.lit(counted["DoW"]).alias("dow_columns"))


@register("cast_precision", with_sql("hi", """select series_id, Period, cast(cast(TS as float) as double) as TS,
    cast(cast(idx / 3 as float) as double) as third from hi"""))
def _(spark, sf):
    with_third = hi(spark, sf).select("series_id", "Period", "TS", (F.col("idx") / 3).alias("third"))
    narrow = splits.cast_precision(with_third, ["TS", "third"], 32)
    return splits.cast_precision(narrow, ["TS", "third"], 64)


# ---- scaling

PAIR_SQL = "select series_id, Period, TS, lag(TS, 24) over (partition by series_id order by Period) as Previous_24 from h"


def pairs(spark, sf):
    return features.add_lags(hi(spark, sf), ["1d"], 1).drop("idx").na.drop("any")


PAIRS = f"select * from ({PAIR_SQL}) q where Previous_24 is not null"


def scaled(method, **options):
    def query(spark, sf):
        rows = pairs(spark, sf)
        params = scaling.fit_scaler(rows, ["TS", "Previous_24"], method, **options)
        out = scaling.scale(rows, params, ["TS", "Previous_24"], **options)
        return rounded(out, "TS", "Previous_24")

    return query


def scaled_sql(center, spread):
    def column(c):
        return f"round(({c} - {center.format(c=c)}) / {spread.format(c=c)}, 6) as {c}"

    return with_sql("h", f"""select series_id, Period, {column('TS')}, {column('Previous_24')} from pairs""", pairs=PAIRS)


OVER = "over (partition by series_id)"
QUERIES["scale_minmax"] = (
    scaled("MinMaxScaler"),
    scaled_sql("min({c}) " + OVER, "(max({c}) " + OVER + " - min({c}) " + OVER + ")"),
)
QUERIES["scale_standard"] = (scaled("StandardScaler"), scaled_sql("avg({c}) " + OVER, "stddev_pop({c}) " + OVER))
QUERIES["scale_maxabs"] = (scaled("MaxAbsScaler"), scaled_sql("0", "max(abs({c})) " + OVER))
QUERIES["scale_robust"] = (
    scaled("RobustScaler"),
    scaled_sql(
        "median({c}) " + OVER, "(quantile_cont({c}, 0.75) " + OVER + " - quantile_cont({c}, 0.25) " + OVER + ")"
    ),
)


@register("scale_normalizer", with_sql("h", """select series_id, Period, round(TS / l, 6) as TS,
    round(Previous_24 / l, 6) as Previous_24 from (select *, sqrt(TS * TS + Previous_24 * Previous_24) as l from pairs) q""",
    pairs=PAIRS))
def _(spark, sf):
    return rounded(scaling.normalize_rows(pairs(spark, sf), ["TS", "Previous_24"]), "TS", "Previous_24")


GRID_POINTS = 11


@register("scale_quantile", with_sql("h", """select a.series_id, a.Period, round(case
    when a.TS <= first.v then 0 when a.TS >= last.v then 1
    else (lo.i + (a.TS - lo.v) / (hi.v - lo.v)) / 10 end, 6) as TS
    from h a join grid first on first.series_id = a.series_id and first.i = 0
    join grid last on last.series_id = a.series_id and last.i = 10
    left join grid lo on lo.series_id = a.series_id and lo.v <= a.TS
    left join grid hi on hi.series_id = a.series_id and hi.i = lo.i + 1
    where (hi.v > a.TS) or (a.TS >= last.v and lo.i = 10)""",
    levels="select unnest(generate_series(0, 10)) as i",
    grid="""select series_id, i, l[i + 1] as v from levels, (select series_id, quantile_cont(TS,
        [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as l from h group by 1) q"""))
def _(spark, sf):
    rows = h(spark, sf)
    params = scaling.fit_scaler(rows, ["TS"], "QuantileTransformer", points=GRID_POINTS)
    return rounded(scaling.scale(rows, params, ["TS"], points=GRID_POINTS), "TS")


@register("unscale", with_sql("h", """select 'RobustScaler' as method, series_id, Period, round(TS, 4) as TS from h
    union all select 'QuantileTransformer', series_id, Period, round(TS, 4) from h"""))
def _(spark, sf):
    rows = h(spark, sf)
    out = []
    for method in ("RobustScaler", "QuantileTransformer"):
        params = scaling.fit_scaler(rows, ["TS"], method, points=GRID_POINTS)
        there = scaling.scale(rows, params, ["TS"], points=GRID_POINTS)
        back = scaling.unscale(there, params, ["TS"], points=GRID_POINTS)
        out.append(back.select(F.lit(method).alias("method"), "series_id", "Period", F.round("TS", 4).alias("TS")))
    return out[0].unionByName(out[1])


# ---- blocks and folds


@register("records_per_hour", with_sql("h ht", """select series_id, count(*) as per_hour, count(*) * 24 as per_day,
    count(*) * 168 as per_week from (select *, min(Period) over (partition by series_id) as p0 from both_) q
    where Period < p0 + interval 1 hour group by 1""", both_="select * from h union all select * from ht"))
def _(spark, sf):
    return splits.records_per_hour(h(spark, sf).unionByName(ht(spark, sf)))


@register("complete_blocks", with_sql("ht", """select series_id, Period, TS, strftime(Period, '%Y-%m-%d') as block from ht
    where (series_id, cast(Period as date)) in (select (series_id, cast(Period as date)) from ht group by series_id,
    cast(Period as date) having count(*) = 24)"""))
def _(spark, sf):
    return splits.complete_blocks(ht(spark, sf), "day").select("series_id", "Period", "TS", "block")


@register("horizon_blocks", with_sql("h d", """select series_id, Period, strftime(Period, '%Y-%m-%d %H') as hour_block,
    strftime(Period, '%Y-%m-%d') as day_block, printf('%d-W%02d', year(Period), week(Period)) as week_block,
    printf('%d-W%02d', isoyear(Period), week(Period)) as iso_week_block
    from (select * from h union all select * from d) q"""))
def _(spark, sf):
    both = h(spark, sf).unionByName(d(spark, sf))
    period = F.col("Period")
    return both.select(
        "series_id",
        "Period",
        clock.horizon_block(period, "hour").alias("hour_block"),
        clock.horizon_block(period, "day").alias("day_block"),
        clock.horizon_block(period, "week").alias("week_block"),
        clock.horizon_block(period, "week", iso_year=True).alias("iso_week_block"),
    )


@register("block_mask", with_sql("hi", """select series_id, Period, TS, idx,
    case when (idx - first) % 24 >= 1 then 0.0 else Previous_1 end as Previous_1,
    case when (idx - first) % 24 >= 2 then 0.0 else Previous_2 end as Previous_2, Previous_24, Previous_168
    from (select *, min(idx) over (partition by series_id) as first from lags where Previous_168 is not null) q""",
    lags=LAGS_SQL))
def _(spark, sf):
    known = features.add_historical_ts(hi(spark, sf), ["1-2h", "1d", "7d"])
    return splits.block_mask(known, [1, 2, 24, 168], 24)


FOLDS_SQL = """select f.fold, case when y.rk < f.fold + 3 then 'train' else 'test' end as role, y.series_id, y.year
    from (select series_id, year, dense_rank() over (partition by series_id order by year) - 1 as rk,
    count(*) over (partition by series_id) as n from (select distinct series_id, year(Period) as year from d) a) y
    join (select unnest(generate_series(0, 20)) as fold) f on y.rk between f.fold and f.fold + 3 and f.fold <= y.n - 4"""


@register("cv_splits", with_sql("d", """select d.series_id, d.Period, d.TS, cast(fold as int) as fold, role from d
    join folds f on f.series_id = d.series_id and f.year = year(d.Period)""", folds=FOLDS_SQL))
def _(spark, sf):
    return splits.cv_splits(d(spark, sf), (3, 1)).withColumn("fold", F.col("fold").cast("int"))


@register("block_tensor", with_sql("ht", """select series_id, strftime(Period, '%Y-%m-%d') as block,
    cast(row_number() over (partition by series_id, cast(Period as date) order by Period) - 1 as int) as step,
    round(TS, 6) as x0, cast(hour(Period) as double) as x1, round(TS, 6) as y from ht
    where (series_id, cast(Period as date)) in (select (series_id, cast(Period as date)) from ht group by series_id,
    cast(Period as date) having count(*) = 24)"""))
def _(spark, sf):
    rows = ht(spark, sf).withColumn("hour", F.hour("Period"))
    tensor = splits.block_tensor(rows, ["TS", "hour"], "day")
    steps = tensor.select("series_id", "block", F.posexplode(F.arrays_zip("x", "y")).alias("step", "row"))
    return steps.select(
        "series_id",
        "block",
        "step",
        F.round(F.col("row.x")[0], 6).alias("x0"),
        F.col("row.x")[1].alias("x1"),
        F.round("row.y", 6).alias("y"),
    )


# ---- models

# Million-scale sums keep their digits when the load is in millions.
MODEL_SQL = {
    "di": DI,
    "folds": FOLDS_SQL,
    "rows_": """select a.series_id, a.Period, a.TS / 1e6 as TS, lag(a.TS, 7) over (partition by a.series_id order by idx) / 1e6
        as Previous_7 from di a""",
    "sets": """select r.*, cast(f.fold as int) as fold, f.role from rows_ r join folds f on f.series_id = r.series_id
        and f.year = year(r.Period) where Previous_7 is not null""",
    "lines": """select series_id, fold, regr_slope(TS, Previous_7) as slope, regr_intercept(TS, Previous_7) as intercept,
        count(*) as n from sets where role = 'train' group by 1, 2""",
    "scored": """select s.series_id, s.Period, s.fold, s.role, s.TS as actual, l.intercept + l.slope * s.Previous_7 as forecast
        from sets s join lines l using (series_id, fold)""",
}


def in_years(rows):
    """Folds over rows kept once, in a folder per year."""
    folds = splits.fold_rows(rows, (3, 1))
    return replace(folds, rows=materialise(folds.rows, "rows", [splits.YEAR]))


def sets(spark, sf):
    lagged = features.add_lags(di(spark, sf), ["7r"], 1).drop("idx").na.drop("any")
    return in_years(lagged.withColumns({"TS": F.col("TS") / 1e6, "Previous_7": F.col("Previous_7") / 1e6}))


def scored(spark, sf):
    folds = sets(spark, sf)
    out = linear.predict(folds.all(), linear.train(folds, ["Previous_7"]), ["Previous_7"])
    fold = F.col("fold").cast("int").alias("fold")
    return out.select("series_id", "Period", fold, "role", F.col("TS").alias("actual"), "forecast")


# The normal equations of three features about their means, by Cramer's rule.
THREE_SQL = MODEL_SQL | {
    "three": """select f.series_id, f.fold, TS as y, a, b, c from (select series_id, Period, TS / 1e6 as TS,
        lag(TS) over w / 1e6 as a, lag(TS, 7) over w / 1e6 as b, cast(isodow(Period) - 1 as double) as c
        from di window w as (partition by series_id order by idx)) r
        join folds f on f.series_id = r.series_id and f.year = year(r.Period) where b is not null and f.role = 'train'""",
    "moments": """select series_id, fold, count(*) as n, avg(y) as my, avg(a) as ma, avg(b) as mb, avg(c) as mc,
        var_pop(a) as aa, var_pop(b) as bb, var_pop(c) as cc, covar_pop(a, b) as ab, covar_pop(a, c) as ac,
        covar_pop(b, c) as bc, covar_pop(a, y) as ay, covar_pop(b, y) as by_, covar_pop(c, y) as cy from three group by 1, 2""",
    "solved": """select *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det as wa,
        (aa * (by_ * cc - cy * bc) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det as wb,
        (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det as wc
        from (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as det from moments) q""",
}


@register("train_per_fold", with_sql("d", """select series_id, cast(fold as int) as fold, n,
    round(my - wa * ma - wb * mb - wc * mc, 6) as intercept, round(wa, 6) as Previous_1, round(wb, 6) as Previous_7,
    round(wc, 6) as weekday from solved""", **THREE_SQL))
def _(spark, sf):
    lagged = features.add_lags(di(spark, sf), ["1r", "7r"], 1).drop("idx").na.drop("any")
    rows = lagged.withColumns({c: F.col(c) / 1e6 for c in ("TS", "Previous_1", "Previous_7")})
    names = ["Previous_1", "Previous_7", "weekday"]
    models = linear.train(in_years(rows.withColumn("weekday", F.weekday("Period").cast("double"))), names)
    weights = {k: F.round(v, 6).alias(k) for k, v in linear.weights(names).items()}
    return models.select("series_id", F.col("fold").cast("int").alias("fold"), "n", *weights.values())


@register("user_model", with_sql("d", """select series_id, Period, fold, role, round(forecast, 5) as forecast
    from scored""", **MODEL_SQL))
def _(spark, sf):
    from pyspark.ml.regression import LinearRegression

    folds = sets(spark, sf)
    models = forecast.train_per_fold(folds, LinearRegression(solver="normal"), ["Previous_7"])
    out = forecast.predict_direct(folds, models, ["series_id", "Period"])
    return out.withColumns({"forecast": F.round("forecast", 5), "fold": F.col("fold").cast("int")})


@register("predict_direct", with_sql("d", """select series_id, Period, fold, role, actual,
    round(forecast, 6) as forecast, round(abs(forecast - actual), 6) as abs_err,
    round(abs(forecast - actual) / actual * 100, 5) as error_pct from scored""", **MODEL_SQL))
def _(spark, sf):
    out = scored(spark, sf)
    return rounded(evaluate.point_errors(out), "forecast", "abs_err").withColumn("error_pct", F.round("error_pct", 5))


@register("evaluate_folds", with_sql("d", """select fold, role, round(avg(abs((actual - forecast) / actual)) * 100, 6) as MAPE,
    round(sqrt(avg(power(actual - forecast, 2))), 6) as RMSE, round(avg(abs(actual - forecast)), 6) as MAE
    from scored group by 1, 2""", **MODEL_SQL))
def _(spark, sf):
    return rounded(forecast.evaluate_folds(scored(spark, sf)), "MAPE", "RMSE", "MAE")


RECURRENT_SQL = "with recursive " + with_sql("hi", """select series_id, strftime(Period, '%Y-%m-%d') as block,
    Period, round(TS, 6) as TS, round(forecast, 6) as forecast from steps""",
    lags="""select *, lag(TS) over (partition by series_id order by idx) as Previous_1 from hi""",
    whole="""select *, cast(Period as date) as day from lags where Previous_1 is not null
        and (series_id, cast(Period as date)) in (select (series_id, cast(Period as date))
        from lags where Previous_1 is not null group by series_id, cast(Period as date) having count(*) = 24)""",
    line="""select series_id, regr_slope(TS, Previous_1) as slope, regr_intercept(TS, Previous_1) as intercept
        from lags where Previous_1 is not null group by 1""",
    steps="""select w.series_id, w.day, w.Period, w.TS, l.intercept + l.slope * w.Previous_1 as forecast
        from whole w join line l using (series_id) where hour(w.Period) = 0
        union all select w.series_id, w.day, w.Period, w.TS, l.intercept + l.slope * s.forecast
        from steps s join whole w on w.series_id = s.series_id and w.Period = s.Period + interval 1 hour and w.day = s.day
        join line l on l.series_id = w.series_id""").removeprefix("with ")


@register("predict_recurrent", RECURRENT_SQL)
def _(spark, sf):
    lagged = features.add_lags(hi(spark, sf), ["1h"], 1).na.drop("any")
    lines = forecast.fit_line(lagged, "Previous_1", by=["series_id"])
    rows = attach(lagged, lines, ["series_id"])
    weights = {"intercept": F.col("intercept"), "Previous_1": F.col("slope")}
    out = forecast.predict_recurrent(rows, weights, [1], by=["series_id"])
    return rounded(out, "TS", "forecast")


@register("predict_recurrent_model", RECURRENT_SQL)
def _(spark, sf):
    """The same line as a user's model, called from Python."""
    lagged = features.add_lags(hi(spark, sf), ["1h"], 1).na.drop("any")
    rows = attach(lagged, forecast.fit_line(lagged, "Previous_1", by=["series_id"]), ["series_id"])

    def predict(frame):
        return frame["intercept"] + frame["slope"] * frame["Previous_1"]

    out = forecast.predict_recurrent_with(rows, predict, ["intercept", "slope", "Previous_1"], [1], by=["series_id"])
    return rounded(out, "TS", "forecast")


@register("apply_partitions", with_sql("h", "select series_id, Period, TS, round(TS * 1.1, 6) as raised from h"))
def _(spark, sf):
    rows = h(spark, sf)

    def raised(batch):
        return batch.assign(raised=(batch["TS"] * 1.1).round(6))

    return forecast.map_partitions(rows, raised, "series_id string, Period timestamp_ntz, TS double, raised double")


# ---- errors

PF = "from pf"


@register("point_errors", with_sql("pf", """select *, round(abs(forecast - actual), 6) as abs_err,
    round(abs(forecast - actual) / actual * 100, 6) as error_pct from pf"""))
def _(spark, sf):
    return rounded(evaluate.point_errors(pf(spark, sf)), "abs_err", "error_pct")


MAPE_SQL = "round(avg(abs((actual - forecast) / nullif(actual, 0))) * 100, 6) as MAPE"
RMSE_SQL = "round(sqrt(avg(power(actual - forecast, 2))), 6) as RMSE"
MAE_SQL = "round(avg(abs(actual - forecast)), 6) as MAE"


def one_metric(name):
    return lambda spark, sf: rounded(evaluate.get_measures(pf(spark, sf), "global", name), name)


QUERIES["mape"] = (one_metric("MAPE"), with_sql("pf", f"select {MAPE_SQL} from pf"))
QUERIES["rmse"] = (one_metric("RMSE"), with_sql("pf", f"select {RMSE_SQL} from pf"))
QUERIES["mae"] = (one_metric("MAE"), with_sql("pf", f"select {MAE_SQL} from pf"))


@register("measures_by_period", with_sql("pf", f"""select cast(isodow(Period) - 1 as int) as DoW, {MAPE_SQL} from pf
    group by grouping sets ((1), ())"""))
def _(spark, sf):
    return rounded(evaluate.measures_with_global(pf(spark, sf), "DoW"), "MAPE")


@register("group_lambda", with_sql("pf", """select cast(hour(Period) as int) as hour,
    round(sum(abs(actual - forecast)) / sum(abs(actual)) * 100, 6) as WAPE from pf group by 1"""))
def _(spark, sf):
    """A metric of the user's own: the sum of errors as a share of the load."""
    rows = pf(spark, sf).withColumn("hour", clock.period_group(F.col("Period"), "hour"))

    def sums(actual, predicted):
        return abs(actual - predicted).sum(), abs(actual).sum()

    out = evaluate.group_metric(rows, ["hour"], ["actual", "forecast"], sums, lambda s: s[0] / s[1] * 100, "WAPE")
    return rounded(out, "WAPE")


@register("fold_summary", with_sql("d", """select round(avg(m), 6) as mean_MAPE from (select fold, dayofyear(Period) as doy,
    avg(abs((actual - forecast) / actual)) * 100 as m from scored where role = 'test' group by 1, 2) q""", **MODEL_SQL))
def _(spark, sf):
    return rounded(evaluate.fold_summary(scored(spark, sf).filter(F.col("role") == "test")), "mean_MAPE")


@register("rolling_mean", with_sql("pf", """select series_id, Period, round(error_pct, 6) as error_pct,
    round(case when count(*) over w = 24 then avg(error_pct) over w end, 6) as rolling from
    (select *, abs(forecast - actual) / actual * 100 as error_pct from pf) q
    window w as (partition by series_id order by Period rows between 23 preceding and current row)"""))
def _(spark, sf):
    errors = evaluate.point_errors(pf(spark, sf))
    out = evaluate.rolling_mean(errors, "error_pct", 24)
    return rounded(out.select("series_id", "Period", "error_pct", "rolling"), "error_pct", "rolling")


@register("align_pred_true", with_sql("h ht", """select series_id, Period, a.TS as actual, round(b.TS, 6) as forecast from ht a
    join (select series_id, Period + interval 1 day as Period, TS from ht) b using (series_id, Period)"""))
def _(spark, sf):
    actual = ht(spark, sf)
    day_before = actual.withColumn("Period", clock.shift(F.col("Period"), clock.DAY))
    return rounded(evaluate.align(actual, day_before), "forecast")


@register("box_stats", with_sql("h", """select hour, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
    min(TS) filter (TS >= q1 - 1.5 * (q3 - q1) and TS <= q3 + 1.5 * (q3 - q1)) as whisker_low,
    max(TS) filter (TS >= q1 - 1.5 * (q3 - q1) and TS <= q3 + 1.5 * (q3 - q1)) as whisker_high,
    count(*) filter (not (TS >= q1 - 1.5 * (q3 - q1) and TS <= q3 + 1.5 * (q3 - q1))) as outliers
    from (select cast(hour(Period) as int) as hour, TS, quantile_cont(TS, 0.25) over w as q1, median(TS) over w as median,
    quantile_cont(TS, 0.75) over w as q3 from h window w as (partition by hour(Period))) q group by all"""))
def _(spark, sf):
    hourly = h(spark, sf).withColumn("hour", clock.period_group(F.col("Period"), "hour"))
    return rounded(evaluate.box_stats(hourly, "TS", ["hour"]), "q1", "median", "q3")


@register("density_histogram", with_sql("h", """select series_id, bin, round(lo + bin * w, 6) as bin_start,
    round(count(*) / (n * w), 6) as density from (select series_id, lo, n, (hi - lo) / 25 as w,
    cast(least(floor((TS - lo) / ((hi - lo) / 25)), 24) as int) as bin from (select *, min(TS) over p as lo,
    max(TS) over p as hi, count(*) over p as n from h window p as (partition by series_id)) a) b
    group by series_id, bin, lo, n, w"""))
def _(spark, sf):
    return rounded(evaluate.density_histogram(h(spark, sf), "TS"), "bin_start", "density")
