"""Queries on experiment runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.catalog.fixtures import d, j, run, with_sql
from gridseries.catalog.registry import registry, rounded
from gridseries.functions import params
from gridseries.operators import evaluate, features, runs, timegrid
from gridseries.session import materialise, new_folder

QUERIES, register = registry()


@register("scan_runs", with_sql("run", """select 'one flag' as part, * from run where flag = 'lr_benchmark'
    union all select 'any flag', * from run where flag is not null"""))
def _(spark, sf):
    all_ = run(spark, sf)
    one = runs.scan_runs(all_, "lr_benchmark").select(F.lit("one flag").alias("part"), "*")
    return one.unionByName(runs.scan_runs(all_).select(F.lit("any flag").alias("part"), "*"))


@register("last_run_id", with_sql("run", "select max(RUN_ID) as RUN_ID from run"))
def _(spark, sf):
    return runs.last_run_id(run(spark, sf))


@register("append_run", with_sql("run", """select RUN_ID, flag, testing_MAPE from run
    union all select max(RUN_ID) + 1, 'lr_benchmark', 1.5 from run"""))
def _(spark, sf):
    """The runs in a store of their own, one more appended, and all read back."""
    store = new_folder(spark, "runs")
    known = run(spark, sf).select("RUN_ID", "flag", "testing_MAPE")
    known.write.parquet(f"{store}/results")
    runs.append_run(spark, store, {}, {"testing_MAPE": 1.5}, "lr_benchmark")
    return runs.read_store(spark, store, "results", runs.RESULT_SCHEMA).select("RUN_ID", "flag", "testing_MAPE")


@register("drop_columns", with_sql("run", "select RUN_ID, flag, location, model_type, testing_MAPE from run"))
def _(spark, sf):
    unneeded = ["batch_size", "layer_count", "units", "training_MAPE", "training_time", "ran_epochs"]
    return run(spark, sf).drop(*unneeded)


@register("join_run_tables", with_sql("run", """select RUN_ID, a.testing_MAPE, b.location, c.ran_epochs
    from (select * from run where flag is not null) a full join run b using (RUN_ID)
    full join run c using (RUN_ID)"""))
def _(spark, sf):
    all_ = run(spark, sf)
    results = runs.scan_runs(all_).select("RUN_ID", "testing_MAPE")
    settings = all_.select("RUN_ID", "location")
    detail = all_.select("RUN_ID", "ran_epochs")
    return runs.join_run_tables(results, settings, detail)


# ---- JSON and architectures


@register("json_parse", with_sql("j", "select event_id, cast(json_extract(props, '$.k') as int) as k from j"))
def _(spark, sf):
    parsed = F.from_json("props", "struct<k: int>")
    return j(spark, sf).select("event_id", parsed["k"].alias("k"))


@register("json_dump", with_sql("j", """select event_id, '{"k":' || json_extract_string(props, '$.k') ||
    case when event_id % 2 = 0 then ',"even":true}' else '}' end as text from j"""))
def _(spark, sf):
    parsed = F.from_json("props", "struct<k: int>")
    even = F.when(F.col("event_id") % 2 == 0, True).alias("even")
    return j(spark, sf).select("event_id", F.to_json(F.struct(parsed["k"].alias("k"), even)).alias("text"))


@register("expand_struct", with_sql("j", """select event_id, cast(json_extract(props, '$.k') as int) as k,
    event_id % 7 as week_place from j"""))
def _(spark, sf):
    nested = j(spark, sf).select(
        "event_id",
        F.struct(F.from_json("props", "struct<k: int>")["k"].alias("k"), (F.col("event_id") % 7).alias("week_place")).alias(
            "props"
        ),
    )
    return runs.expand_struct(nested, "props")


def arch_text():
    """Architecture JSON of a run: its layers, then a dense layer of one unit."""
    kind = runs.strip_backend_prefix(F.col("model_type"))
    size = F.when(kind == "CNN", F.lit('"filters":')).otherwise(F.lit('"units":'))
    layer = F.concat(F.lit('{"class_name":"'), kind, F.lit('","config":{'), size, F.col("units"), F.lit("}}"))
    out = F.lit('{"class_name":"Dense","config":{"units":1}}')
    return F.concat(
        F.lit('{"config":['), F.concat_ws(",", F.array_repeat(layer, F.col("layer_count"))), F.lit(","), out, F.lit("]}")
    )


def architectures(spark, sf):
    return runs.arch_details(run(spark, sf).select("RUN_ID", arch_text().alias("arch")))


KIND = "case when model_type = 'CuDNNLSTM' then 'LSTM' else model_type end"


@register("arch_summary", with_sql("run", f"""select RUN_ID, {KIND} as model_type, layer_count + 1 as layer_count,
    cast(units * layer_count + 1 as bigint) as neuron_count,
    {KIND} || ':' || cast(layer_count + 1 as varchar) || 'x' || cast(units as varchar) as model_summary from run"""))
def _(spark, sf):
    return architectures(spark, sf).select("RUN_ID", "model_type", "layer_count", "neuron_count", "model_summary")


@register("layer_units", with_sql("run", """select RUN_ID, repeat(cast(units as varchar) || ',', layer_count) || '1' as sizes
    from run"""))
def _(spark, sf):
    return architectures(spark, sf).select("RUN_ID", F.array_join("layer_config", ",").alias("sizes"))


@register("array_stats", with_sql("run", f"""select RUN_ID, round((units * layer_count + 1) / (layer_count + 1), 6)
    as average_neuron, units as hidden_neuron, units as first_size,
    repeat({KIND} || ':' || cast(units as varchar) || ' ', layer_count) || 'Dense:1' as model from run"""))
def _(spark, sf):
    return architectures(spark, sf).select(
        "RUN_ID",
        F.round("average_neuron", 6).alias("average_neuron"),
        "hidden_neuron",
        F.get("layer_config", F.lit(0)).alias("first_size"),
        F.array_join("model", " ").alias("model"),
    )


@register("tuple_split", with_sql("run", f"""select RUN_ID, layer_count as train_years, units as test_years,
    testing_MAPE as lr, {KIND} as name, '{{"optimizer_name":"' || {KIND} || '","lr":' || cast(layer_count as varchar)
    || '.5}}' as optimizer from run""".replace("testing_MAPE as lr", "layer_count + cast(0.5 as double) as lr")))
def _(spark, sf):
    lr = F.col("layer_count") + F.lit(0.5)
    nested = run(spark, sf).select(
        "RUN_ID",
        F.array("layer_count", "units").alias("train_test"),
        F.struct(
            runs.strip_backend_prefix(F.col("model_type")).alias("optimizer_name"),
            lr.alias("lr"),
            F.lit(None).cast("double").alias("momentum"),
        ).alias("optimizer"),
    )
    return runs.split_optimizer(runs.split_train_test(nested)).drop("train_test")


@register("strip_backend_prefix", with_sql("run", f"select RUN_ID, {KIND} as model_type from run"))
def _(spark, sf):
    return run(spark, sf).select("RUN_ID", runs.strip_backend_prefix(F.col("model_type")).alias("model_type"))


# ---- reports


@register("sweep_means", with_sql("run", f"""select location, {KIND} as model_type, batch_size,
    round(avg(testing_MAPE), 6) as testing_MAPE, round(avg(training_MAPE), 6) as training_MAPE,
    round(avg(training_time), 6) as training_time from run where flag = 'batch_size_benchmark' group by 1, 2, 3"""))
def _(spark, sf):
    means = runs.sweep_means(runs.scan_runs(run(spark, sf), "batch_size_benchmark"), "batch_size")
    return rounded(means, "testing_MAPE", "training_MAPE", "training_time")


BOX = "{m} >= q1 - 1.5 * (q3 - q1) and {m} <= q3 + 1.5 * (q3 - q1)".format(m="testing_MAPE")


@register("sweep_box", with_sql("run", f"""select location, model_type, batch_size, round(q1, 6) as q1, round(median, 6) as median,
    round(q3, 6) as q3, min(testing_MAPE) filter ({BOX}) as whisker_low, max(testing_MAPE) filter ({BOX}) as whisker_high,
    count(*) filter (not ({BOX})) as outliers
    from (select location, kind as model_type, batch_size, testing_MAPE, quantile_cont(testing_MAPE, 0.25) over w as q1,
    median(testing_MAPE) over w as median, quantile_cont(testing_MAPE, 0.75) over w as q3
    from (select *, {KIND} as kind from run where flag = 'batch_size_benchmark') k
    window w as (partition by location, kind, batch_size)) q group by all"""))
def _(spark, sf):
    swept = materialise(runs.scan_runs(run(spark, sf), "batch_size_benchmark"), "swept")
    return rounded(runs.sweep_box(swept, "batch_size"), "q1", "median", "q3")


@register("sweep_table", with_sql("run", f"""select location, {KIND} as model_type, batch_size, count(*) as runs,
    round(avg(testing_MAPE), 6) as mean_testing_MAPE, min(testing_MAPE) as min_testing_MAPE, max(testing_MAPE) as max_testing_MAPE
    from run where flag = 'batch_size_benchmark' group by 1, 2, 3"""))
def _(spark, sf):
    table = runs.sweep_table(runs.scan_runs(run(spark, sf), "batch_size_benchmark"), "batch_size", ["testing_MAPE"])
    return rounded(table, "mean_testing_MAPE")


@register("sort_metric", with_sql("run", f"""select location, {KIND} as model_type, batch_size,
    round(avg(testing_MAPE), 6) as testing_MAPE from run where flag = 'lr_benchmark' group by 1, 2, 3
    order by testing_MAPE, batch_size"""))
def _(spark, sf):
    means = runs.sweep_means(runs.scan_runs(run(spark, sf), "lr_benchmark"), "batch_size", ["testing_MAPE"])
    return rounded(means, "testing_MAPE").orderBy("testing_MAPE", "batch_size")


@register("sweep_pivot", with_sql("run", "select units, " + ", ".join(
    f"round(avg(testing_MAPE) filter (layer_count = {k}), 6) as layer_count_{k}" for k in (1, 2, 3, 4))
    + " from run group by 1"))
def _(spark, sf):
    wide = runs.sweep_pivot(run(spark, sf), "units", "layer_count", [1, 2, 3, 4])
    return rounded(wide, *[f"layer_count_{k}" for k in (1, 2, 3, 4)])


@register("location_model_rank", with_sql("run", """select location, model_type, round(avg(testing_MAPE), 6) as testing_MAPE,
    round(avg(training_MAPE), 6) as training_MAPE, round(avg(training_time), 6) as training_time
    from run where location = 'O' group by 1, 2 order by 3"""))
def _(spark, sf):
    return rounded(runs.rank_models(run(spark, sf), "O"), "testing_MAPE", "training_MAPE", "training_time")


@register("backend_means", with_sql("run", f"""select {KIND} as model_type, case when model_type = 'CuDNNLSTM' then 'gpu'
    else 'cpu' end as backend, round(avg(training_time), 6) as training_time, round(avg(testing_MAPE), 6) as testing_MAPE
    from run group by 1, 2"""))
def _(spark, sf):
    backend = F.when(F.startswith("model_type", F.lit("CuDNN")), "gpu").otherwise("cpu")
    return rounded(
        runs.backend_means(run(spark, sf).withColumn("backend", backend)), "training_time", "testing_MAPE"
    )


# ---- sweeps


@register("param_grid", with_sql("run", """select location, cell_type, cast(layers as int) as layers,
    cast(units as int) as units, cast(repetition as int) as repetition from (select distinct location from run) l,
    (select unnest(['GRU', 'LSTM']) as cell_type) c, (select unnest(generate_series(1, 3)) as layers) n,
    (select unnest([32, 64, 96]) as units) u, (select unnest([0, 1]) as repetition) r"""))
def _(spark, sf):
    locations = run(spark, sf).select("location").distinct()
    sizes = params.size_range("32-3X", 3, 32)
    return runs.param_grid(
        locations, cell_type=["LSTM", "GRU"], layers=list(range(1, 4)), units=sizes, repetition=[0, 1]
    )


@register("linspace", with_sql("run", """select location, cast(i as int) as place,
    round(lo + i * (hi - lo) / 6, 6) as value from (select location, min(testing_MAPE) as lo, max(testing_MAPE) as hi
    from run group by 1) q, (select unnest(generate_series(0, 6)) as i) s"""))
def _(spark, sf):
    ends = run(spark, sf).groupBy("location").agg(F.min("testing_MAPE").alias("lo"), F.max("testing_MAPE").alias("hi"))
    steps = params.linspace(F.col("lo"), F.col("hi"), 7)
    out = ends.select("location", F.posexplode(steps).alias("place", "value"))
    return rounded(out, "value")


@register("sweep", with_sql("d", " union all ".join(
    f"""select {lag} as value, {rep} as repetition, round(avg(abs((TS - f) / TS)) * 100, 6) as MAPE
    from (select *, lag(TS, {lag}) over (partition by series_id order by Period) as f from d) q where f is not null"""
    for lag in (1, 7, 14) for rep in (0, 1))))
def _(spark, sf):
    days = timegrid.row_index(d(spark, sf))

    def naive(lag):
        lagged = features.add_lags(days, [f"{lag}r"], 1)
        scored = lagged.select(F.col("TS").alias("actual"), F.col(f"Previous_{lag}").alias("forecast"))
        return rounded(evaluate.get_measures(scored.na.drop()), "MAPE")

    return runs.sweep(params.sweep_values(var_list=[1, 7, 14]), 2, naive)


@register("sweep_runs", with_sql("d", """select cast(RUN_ID as bigint) as RUN_ID, points, role, count(*) as n,
    round(sum(TS) / 1e6, 3) as total, min(Period) as first, max(Period) as last from
    (select *, row_number() over (partition by series_id order by Period) - 1 as idx from d) s
    join (select 0 as RUN_ID, 1 as lag, '["1r"]' as points union all select 1, 7, '["7r"]') v on idx >= lag
    join folds f on f.series_id = s.series_id and f.year = year(s.Period) group by all""",
    folds="""select f.fold, case when y.rk < f.fold + 3 then 'train' else 'test' end as role, y.series_id, y.year
    from (select series_id, year, dense_rank() over (partition by series_id order by year) - 1 as rk,
    count(*) over (partition by series_id) as n from (select distinct series_id, year(Period) as year from d) a) y
    join (select unnest(generate_series(0, 20)) as fold) f on y.rk between f.fold and f.fold + 3 and f.fold <= y.n - 4"""))
def _(spark, sf):
    """A sweep over lags through the run store: what each stored run has scored."""
    from gridseries.plans.forecaster import LoadForecaster, benchmark_variable

    forecaster = LoadForecaster(spark, store=new_folder(spark, "sweep"))
    forecaster.override("data", location="NYC")
    forecaster.override("features", averages=[], train_test=(3, 1), stdz="MinMaxScaler")
    forecaster.clean_load = materialise(timegrid.row_index(d(spark, sf)), "load")
    benchmark_variable(lambda: forecaster, "features", "points", [["1r"], ["7r"]], run_count=1)
    runs_ = forecaster.load_results("points_benchmark", detailed=True)
    if runs_.filter("testing_MAPE is null or training_MAPE is null or inference_time_test_set is null").count():
        raise RuntimeError("a stored run has no errors or times")
    points = F.get_json_object("historical_ts", "$.points").alias("points")
    return runs_.groupBy("RUN_ID", points, "role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("actual") / 1e6, 3).alias("total"),
        F.min("Period").alias("first"), F.max("Period").alias("last"),
    )
