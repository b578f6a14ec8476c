"""Queries on stations, places and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridseries.catalog.fixtures import gz, st, table, with_sql
from gridseries.catalog.registry import registry, rounded
from gridseries.functions import geo
from gridseries.operators import clustering, places, stations

QUERIES, register = registry()


def hav(a, b):
    return f"""2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians({b}.LATITUDE - {a}.LATITUDE) / 2), 2)
        + cos(radians({a}.LATITUDE)) * cos(radians({b}.LATITUDE))
        * power(sin(radians({b}.LONGITUDE - {a}.LONGITUDE) / 2), 2))))"""


# ---- places


@register("filter_cities", with_sql("gz", """select * from gz where ADM0_A3 = 'AFRICA' and FEATURECLA like '%Admin-0%'"""))
def _(spark, sf):
    return places.capitals(places.of_country(gz(spark, sf), "AFRICA"))


@register("top_cities", with_sql("gz", "select * from gz order by POP_MIN desc, NAME limit 7"))
def _(spark, sf):
    return places.largest(gz(spark, sf), 7)


@register("union_distinct_cities", with_sql("gz", """select NAME, POP_MIN, FEATURECLA from (select *, row_number() over
    (partition by NAME order by branch) as rn from (select *, 0 as branch from gz where FEATURECLA like '%Admin-0%'
    union all select * from (select *, 1 from gz order by POP_MIN desc, NAME limit 14) t) u) v where rn = 1"""))
def _(spark, sf):
    return places.main_cities(gz(spark, sf), 14).select("NAME", "POP_MIN", "FEATURECLA")


@register("string_ops", with_sql("gz", """select lpad(cast(ord as varchar), 4, '0') as padded, NAME || ':' || admin1 as joined,
    split_part(FEATURECLA, ' ', 1) as first_word, starts_with(NAME, 'A') as starts_a, contains(NAME, 'AN') as has_an,
    replace(FEATURECLA, 'Admin', 'A') as replaced, substr(NAME, 2, 3) as middle,
    array_to_string(list_transform(string_split(NAME, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')
    as capital from gz"""))
def _(spark, sf):
    name = F.col("NAME")
    return gz(spark, sf).select(
        F.lpad(F.col("ord").cast("string"), 4, "0").alias("padded"),
        F.concat_ws(":", name, "admin1").alias("joined"),
        F.split("FEATURECLA", " ")[0].alias("first_word"),
        F.startswith(name, F.lit("A")).alias("starts_a"),
        F.contains(name, F.lit("AN")).alias("has_an"),
        F.replace("FEATURECLA", F.lit("Admin"), F.lit("A")).alias("replaced"),
        F.substring(name, 2, 3).alias("middle"),
        F.initcap(name).alias("capital"),
    )


# ---- stations


@register("round_coords", with_sql("st", """select USAF, round_even(LATITUDE / 7, 3) as LATITUDE,
    round_even(LONGITUDE / 7, 3) as LONGITUDE from st"""))
def _(spark, sf):
    seventh = st(spark, sf).withColumns({c: F.col(c) / 7 for c in ("LATITUDE", "LONGITUDE")})
    return stations.round_coords(seventh)


# Coordinates to drop: those of suppliers in debt, and those of the places, which are mostly no stations.
LISTED = """select LATITUDE, LONGITUDE from st join supplier on USAF = lpad(cast(s_suppkey as varchar), 6, '0')
    where s_acctbal < 0 union all select LATITUDE, LONGITUDE from gz"""


def listed(spark, sf):
    debts = table(spark, sf, "supplier").filter(F.col("s_acctbal") < 0)
    debts = debts.select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("USAF"))
    coords = st(spark, sf).join(debts, "USAF", "left_semi").select("LATITUDE", "LONGITUDE")
    return coords.unionByName(gz(spark, sf).select("LATITUDE", "LONGITUDE"))


@register("anti_by_coords", with_sql("st gz", """select 'kept' as part, USAF, LATITUDE, LONGITUDE from st s where not exists
    (select 1 from listed l where l.LATITUDE = s.LATITUDE and l.LONGITUDE = s.LONGITUDE)
    union all select 'not found', null, LATITUDE, LONGITUDE from listed l where not exists
    (select 1 from st s where l.LATITUDE = s.LATITUDE and l.LONGITUDE = s.LONGITUDE)""", listed=LISTED))
def _(spark, sf):
    all_, drop = st(spark, sf), listed(spark, sf)
    kept = stations.drop_by_coords(all_, drop).withColumn("part", F.lit("kept"))
    unknown = stations.coords_not_found(all_, drop).withColumn("part", F.lit("not found"))
    return kept.unionByName(unknown, allowMissingColumns=True)


NEAREST = f"""select USAF, LATITUDE, LONGITUDE, admin1 as country, round(km, 6) as km from (select s.*, admin1,
    {hav('s', 'g')} as km, row_number() over (partition by USAF order by {hav('s', 'g')}, ord) as rn from st s, gz g) q
    where rn = 1"""


@register("nearest_place_join", with_sql("st gz", "select * from near", near=NEAREST))
def _(spark, sf):
    return rounded(stations.nearest_place(st(spark, sf), gz(spark, sf)), "km")


@register("semi_regions", with_sql("st gz", """select USAF, LATITUDE, LONGITUDE, country from near
    where country in ('AFRICA', 'ASIA')""", near=NEAREST))
def _(spark, sf):
    near = stations.nearest_place(st(spark, sf), gz(spark, sf)).drop("km")
    return stations.keep_regions(near, ["AFRICA", "ASIA"])


@register("haversine_km", with_sql("st", f"select USAF, round({hav('s', 'o')}, 6) as km from st s, "
    "(select 55.0 as LATITUDE, -3.0 as LONGITUDE) o"))
def _(spark, sf):
    km = geo.haversine_km(F.col("LATITUDE"), F.col("LONGITUDE"), F.lit(55.0), F.lit(-3.0))
    return st(spark, sf).select("USAF", F.round(km, 6).alias("km"))


# ---- clusters

REACH_KM = 75.0
EDGES = f"select a.USAF as a, b.USAF as b, {hav('a', 'b')} as km from st a, st b where a.USAF < b.USAF"


@register("radius_neighbours", with_sql("st", "select a, b, round(km, 6) as km from edges where km <= 75", edges=EDGES))
def _(spark, sf):
    return rounded(clustering.radius_neighbours(st(spark, sf), REACH_KM), "km")


def closure_sql(reaches):
    """Recursive steps giving `labels` (var, USAF, label) for each candidate reach."""
    vars_ = " union all ".join(f"select {r}.0 as var" for r in reaches)
    return {
        "edges": EDGES,
        "vars": vars_,
        "links": """select var, a, b from edges, vars where km <= var union all select var, b, a from edges, vars
            where km <= var union all select var, USAF, USAF from st, vars""",
        "reached": """select var, USAF, USAF as other from st, vars
            union select r.var, r.USAF, l.b from reached r join links l on l.var = r.var and l.a = r.other""",
        "labels": "select var, USAF, min(other) as label from reached group by 1, 2",
    }


def recursive(names, body, **steps):
    return "with recursive " + with_sql(names, body, **steps).removeprefix("with ")


@register("cluster_dbscan", recursive("st", "select cast(var as double) as var, USAF, label from labels",
    **closure_sql([60, 75, 90])))
def _(spark, sf):
    return clustering.dbscan(st(spark, sf), [60.0, 75.0, 90.0])


@register("cluster_count", recursive("st", """select cast(var as double) as var, count(*) filter (n >= 2) as clusters
    from (select var, label, count(*) as n from labels group by 1, 2) q group by 1""", **closure_sql([60, 75, 90])))
def _(spark, sf):
    return clustering.cluster_count(clustering.dbscan(st(spark, sf), [60.0, 75.0, 90.0]), 2)


COUNTS = """select var, count(*) filter (n >= 2) as clusters from (select var, label, count(*) as n from labels
    group by 1, 2) q group by 1"""


@register("argmin_param", recursive("st", """select cast(var as double) as var, clusters from counts
    order by abs(clusters - 16), var limit 1""", **closure_sql([60, 75, 90]), counts=COUNTS))
def _(spark, sf):
    labels = clustering.dbscan(st(spark, sf), [60.0, 75.0, 90.0])
    return clustering.closest_var(clustering.cluster_count(labels, 2), 16)


NUMBERED = """select st.*, dense_rank() over (order by label) - 1 as cluster_num from st join labels using (USAF)
    where var = (select var from best)"""
CENTER = """select cluster_num, avg(LATITUDE) as LATITUDE, avg(LONGITUDE) as LONGITUDE, count(*) as n
    from numbered group by 1"""
CHOSEN = f"""select cluster_num, USAF, km from (select s.cluster_num, s.USAF, round({hav('s', 'c')}, 9) as km, row_number() over
    (partition by s.cluster_num order by round({hav('s', 'c')}, 9), s.USAF) as rn from numbered s
    join center c using (cluster_num)) q where rn = 1"""
CLUSTERED = """select n.USAF, LATITUDE, LONGITUDE, cluster_num, c.USAF is not null as is_centroid from numbered n
    left join chosen c using (cluster_num, USAF)
    where cluster_num in (select cluster_num from center where n >= 2)"""


@register("clusterize", recursive("st", "select USAF, LATITUDE, LONGITUDE, cluster_num, is_centroid from clustered",
    **closure_sql([75]), best="select 75.0 as var", numbered=NUMBERED, center=CENTER,
    chosen=CHOSEN, clustered=CLUSTERED))
def _(spark, sf):
    out = clustering.clusterize(st(spark, sf), min_size=2, algorithm="dbscan", var=REACH_KM)
    return out.withColumn("cluster_num", F.col("cluster_num").cast("long"))


@register("scan_bandwidth", recursive("st", "select USAF, LATITUDE, LONGITUDE, cluster_num, is_centroid from clustered",
    **closure_sql([60, 75, 90]), counts=COUNTS, best="select var from counts order by abs(clusters - 16), var limit 1",
    numbered=NUMBERED, center=CENTER, chosen=CHOSEN, clustered=CLUSTERED))
def _(spark, sf):
    out = clustering.clusterize(st(spark, sf), 16, 2, "dbscan", candidates=[60.0, 75.0, 90.0])
    return out.withColumn("cluster_num", F.col("cluster_num").cast("long"))


# Flat-kernel mean shift, seed by seed; modes are kept from the heaviest down unless a kept one covers them.
BANDWIDTHS = (1.0, 2.0)


def shift_sql():
    away = "sqrt(power({a}.lat - {b}.lat, 2) + power({a}.lon - {b}.lon, 2))"
    vars_ = " union all ".join(f"select cast({v} as double) as var" for v in BANDWIDTHS)
    return {
        "spots": "select LATITUDE as lat, LONGITUDE as lon, count(*) as w from st group by all",
        "vars": vars_,
        "walk": f"""select var, lat as seed_lat, lon as seed_lon, lat, lon, false as rests, cast(0 as bigint) as n from spots, vars
            union all select var, seed_lat, seed_lon, to_lat, to_lon,
            sqrt(power(to_lat - from_lat, 2) + power(to_lon - from_lon, 2)) <= var * 1e-3, total
            from (select var, seed_lat, seed_lon, k.lat as from_lat, k.lon as from_lon, cast(sum(w) as bigint) as total,
            round(sum(s.lat * w) / sum(w), 9) as to_lat, round(sum(s.lon * w) / sum(w), 9) as to_lon
            from walk k join spots s on {away.format(a="k", b="s")} <= var where not rests group by 1, 2, 3, 4, 5) q""",
        "modes": """select *, row_number() over (partition by var order by n desc, lat desc, lon desc) as i
            from (select var, lat, lon, max(n) as n from walk where rests group by 1, 2, 3) q""",
        "chosen": f"""select var, cast(0 as bigint) as i, cast([] as struct(lat double, lon double)[]) as kept from vars
            union all select c.var, m.i, case when len(list_filter(kept, lambda x: {away.format(a="x", b="m")} <= c.var)) = 0
            then list_append(kept, struct_pack(lat := m.lat, lon := m.lon)) else kept end
            from chosen c join modes m on m.var = c.var and m.i = c.i + 1""",
        "kept": """select var, unnest(range(0, len(kept))) as label, unnest(kept).lat as lat, unnest(kept).lon as lon
            from chosen where (var, i) in (select (var, max(i)) from chosen group by var)""",
        "near": f"""select s.var, s.lat, s.lon, label, row_number() over (partition by s.var, s.lat, s.lon
            order by {away.format(a="s", b="k")}, label) as place from (select * from spots, vars) s
            join kept k on k.var = s.var and {away.format(a="s", b="k")} <= s.var""",
    }


@register("cluster_meanshift", recursive("st", """select v.var, USAF, cast(coalesce(label, -1) as int) as label
    from st cross join vars v left join near n on n.var = v.var and n.lat = LATITUDE and n.lon = LONGITUDE and place = 1""",
    **shift_sql()))
def _(spark, sf):
    return clustering.meanshift(st(spark, sf), list(BANDWIDTHS)).withColumn("label", F.col("label").cast("int"))


def dealt(spark, sf):
    """Stations dealt to clusters of growing size by number."""
    number = F.col("USAF").cast("int")
    return st(spark, sf).withColumn("cluster_num", F.when(number % 7 == 0, number % 35).otherwise(number % 7).cast("int"))


DEALT = """select *, cast(case when cast(USAF as int) % 7 = 0 then cast(USAF as int) % 35 else cast(USAF as int) % 7 end as int)
    as cluster_num from st"""
DEALT_CENTER = CENTER.replace("numbered", "dealt")
DEALT_CHOSEN = CHOSEN.replace("numbered", "dealt")


@register("cluster_centroid", with_sql("st", """select cluster_num, round(LATITUDE, 6) as center_lat,
    round(LONGITUDE, 6) as center_lon, n from center""", dealt=DEALT, center=DEALT_CENTER))
def _(spark, sf):
    return rounded(clustering.cluster_centroids(dealt(spark, sf)), "center_lat", "center_lon")


@register("nearest_to_centroid", with_sql("st", "select cluster_num, USAF, round(km, 6) as km from chosen", dealt=DEALT,
    center=DEALT_CENTER, chosen=DEALT_CHOSEN))
def _(spark, sf):
    return rounded(clustering.nearest_to_centroid(dealt(spark, sf)), "km")


@register("flag_membership", with_sql("st", """select s.*, c.USAF is not null as is_centroid from dealt s
    left join chosen c using (cluster_num, USAF)""", dealt=DEALT, center=DEALT_CENTER, chosen=DEALT_CHOSEN))
def _(spark, sf):
    return clustering.flag_centroids(dealt(spark, sf))


@register("semi_valid_clusters", with_sql("st", """select * from dealt where cluster_num in
    (select cluster_num from dealt group by 1 having count(*) >= 10)""", dealt=DEALT))
def _(spark, sf):
    return clustering.keep_valid_clusters(dealt(spark, sf), 10)


@register("centroid_filter", with_sql("st", """select s.cluster_num, s.USAF from dealt s
    join chosen c using (cluster_num, USAF)""", dealt=DEALT, center=DEALT_CENTER, chosen=DEALT_CHOSEN))
def _(spark, sf):
    flagged = clustering.flag_centroids(dealt(spark, sf))
    return clustering.split_centroids(flagged)[0].select("cluster_num", "USAF")


@register("centroid_sanity", with_sql("st", """select cluster_num, count(*) filter (cast(USAF as int) % 14 = 1) as centroids
    from dealt group by 1 having count(*) filter (cast(USAF as int) % 14 = 1) <> 1""", dealt=DEALT))
def _(spark, sf):
    return clustering.centroid_sanity(
        dealt(spark, sf).withColumn("is_centroid", F.col("USAF").cast("int") % 14 == 1)
    )
