"""Registered queries of sources, sinks, sets and smaller expressions, and DuckDB SQL with the same rows.

What a sink writes goes to the shared folder and is read back by the matching scan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as Q
from .functions import scalar as S
from .operators import mosaic, product, series
from .plans import fixtures as X
from .queries import BY, CELL, _query
from .sources import tables as T

EVI = ["EVImax", "EVIamp", "EVIarea"]
_ANNUAL = """, a as (select site_id, cell, cast(year(slot_date) as int) as year, round(max(vi)*10000,4) as EVImax, round((max(vi)-min(vi))*10000,4) as EVIamp,
 round(sum(vi)*100,4) as EVIarea from curve group by all),
 l as (unpivot a on EVImax, EVIamp, EVIarea into name short_name value val)"""


@_query("select cast(site_id as int) as site_id, cell, count(*) as n, cast(sum(red) as bigint) as sum_red from obs group by site_id, cell", "obs")
def a1_scan_scene_pixels(spark, sf):
    path = T.scratch_path(spark, "scene-pixels")
    X.obs(spark, sf).write.partitionBy("site_id").parquet(path)
    return T.scan_scene_pixels(spark, path).groupBy("site_id", "cell").agg(F.count("*").alias("n"), F.sum("red").alias("sum_red"))


@_query("select quality_category, ground_control, count(*) as n, min(acquired) as first_day, round(max(cloud_cover),6) as cloudiest from items group by all", "items")
def a7_scan_catalog(spark, sf):
    """Items go out as search-result pages of 250 ids at most, a JSON object a line."""
    path = T.scratch_path(spark, "catalog")
    properties = F.struct(F.col("acquired").cast("string").alias("acquired"), "cloud_cover", "quality_category", "ground_control")
    item = F.struct(
        F.col("item_id").cast("string").alias("id"), properties.alias("properties"), F.array(F.lit("download")).alias("_permissions"),
        F.array(F.lit("analytic"), F.lit("udm")).alias("assets"),
    )
    pages = X.items(spark, sf).groupBy(F.floor(F.col("item_id") / 250).alias("page")).agg(F.collect_list(item).alias("features"))
    pages.select("features").write.json(path)
    found = T.scan_catalog(spark, path).where(F.array_contains("assets", "udm") & F.array_contains("permissions", "download"))
    return found.groupBy("quality_category", "ground_control").agg(
        F.count("*").alias("n"), F.min("acquired").alias("first_day"), F.round(F.max("cloud_cover"), 6).alias("cloudiest")
    )


@_query("select m.cell, count(*) as n, max(w.occ) as occ from good m join water w using (cell) group by m.cell", "good", "water")
def c3_join_water(spark, sf):
    path = T.scratch_path(spark, "water")
    X.water(spark, sf).write.parquet(path)
    good = X.series(spark, sf).where("vi is not null")
    return good.join(T.scan_water(spark, path), "cell").groupBy("cell").agg(F.count("*").alias("n"), F.max("occ").alias("occ"))


@_query("select cast(site_id as bigint) as site_id, year(obs_date) as year, count(*) as n, count(red) as n_red from daily group by all", "daily")
def a10_write_daily(spark, sf):
    path = T.scratch_path(spark, "daily")
    T.write_daily(mosaic.daily_pipeline(X.obs(spark, sf)), path)
    by = [F.col(c).cast("long").alias(c) for c in ("site_id", "year")]
    return spark.read.parquet(path).groupBy(*by).agg(F.count("*").alias("n"), F.count("red").alias("n_red"))


@_query(
    """select chunk, count(*) as n, count(distinct cell) as n_cells from
 (select *, cast(least(floor((cell-1) / greatest(floor((select count(*) from supplier) / 20), 1)), 19) + 1 as bigint) as chunk from daily) group by chunk""",
    "daily",
)
def a11_write_chunks(spark, sf):
    path = T.scratch_path(spark, "chunks")
    n = X.table(spark, sf, "supplier").count()
    T.write_chunks(mosaic.chunked(mosaic.daily_pipeline(X.obs(spark, sf)), 20, n), path)
    return spark.read.parquet(path).groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.count_distinct("cell").alias("n_cells"))


def _annual(spark, sf):
    return product.to_long(Q.d7_annual_metrics(spark, sf), BY, EVI)


@_query(
    _ANNUAL
    + """ select printf('%02d_%d_%s', case short_name when 'EVImax' then 9 when 'EVIamp' then 10 else 11 end, year, short_name) as layer, count(*) as n,
 round(max(val),4) as hi from l group by all""",
    "curve",
)
def a12_write_layers(spark, sf):
    path = T.scratch_path(spark, "layers")
    T.write_layers(product.layer_catalog_join(_annual(spark, sf)), path)
    return spark.read.parquet(path).groupBy("layer").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("hi"))


@_query(
    _ANNUAL
    + """, k as (select *, cast(trunc(case when val between 0 and case when short_name = 'EVIarea' then 32766 else 10000 end then val else 32767 end) as bigint) as packed from l)
 select year, count(*) as n, cast(sum(packed) as bigint) as total, 23 * count(distinct site_id || '/' || cell) as filled from k where short_name = 'EVImax' group by year""",
    "curve",
)
def a13_write_product(spark, sf):
    path = T.scratch_path(spark, "product")
    """Of one layer; every other column is filled, as is what is out of range."""
    T.write_product(product.pack(_annual(spark, sf)).where("short_name = 'EVImax'").select(*BY, "short_name", "packed"), path, {"title": "yearly values"})
    empty = [c for c in product.LAYER_NAMES if c != "EVImax"]
    filled = sum(F.count_if(F.col(f"`{c}`") == 32767) for c in empty)
    return spark.read.parquet(path).groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("EVImax").alias("total"), filled.alias("filled"))


@_query(Q._NEAR + " select k, count(*) as n_matched, cast(max(days_apart) as int) as farthest from m where m.n = 1 group by k", "years")
def a14_write_match(spark, sf):
    path = T.scratch_path(spark, "match")
    T.write_match(Q.c12_nearest_within(spark, sf), path)
    return spark.read.parquet(path).groupBy("k").agg(F.count("*").alias("n_matched"), F.max("days_apart").alias("farthest"))


@_query(_ANNUAL + " select site_id, cell, year, EVImax, EVIamp, EVIarea from a where year = 1998", "curve")
def b14_split_year_layers(spark, sf):
    return product.to_wide(product.year_layers(_annual(spark, sf), 1998), BY, EVI)


@_query("select distinct obs_date from daily", "daily")
def d11_distinct_values(spark, sf):
    return mosaic.daily_pipeline(X.obs(spark, sf)).select("obs_date").distinct()


@_query("select c_mktsegment as class from customer union select o_orderpriority from orders")
def g4_union_distinct(spark, sf):
    a = X.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("class")).distinct()
    return a.union(X.table(spark, sf, "orders").select("o_orderpriority").distinct()).distinct()


@_query(
    """, d as (select site_id, cell, round(vi - lag(vi) over (partition by site_id, cell order by obs_date), 6) as d from good)
 select site_id, cell, case when d > 0 then 1 when d < 0 then 2 else 0 end as code, count(*) as n from d group by all""",
    "good",
)
def h20_direction_code(spark, sf):
    steps = series.diff_series(X.series(spark, sf).where("vi is not null"), "vi")
    return steps.groupBy(*CELL, S.direction_code(F.round("d_value", 6)).alias("code")).agg(F.count("*").alias("n"))


@_query(
    """select cell, round(cast(x - 1.5 - 0.0015 as double), 4) as west, round(cast(y - 1.5 - 0.0015 as double), 4) as south, round(cast(x + 1.5 + 0.0015 as double), 4) as east, round(cast(y + 1.5 + 0.0015 as double), 4) as north from grid""",
    "grid",
)
def h14_buffer_ring(spark, sf):
    at = lambda i, j: F.struct((F.col("x") + 1.5 * i).alias("lon"), (F.col("y") + 1.5 * j).alias("lat"))
    ring = S.buffer_ring(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1)))
    rows = X.grid(spark, sf).withColumn("r", ring)
    low, high = F.col("r")[0], F.col("r")[2]
    return rows.select(
        "cell", F.round(low["lon"], 4).alias("west"), F.round(low["lat"], 4).alias("south"), F.round(high["lon"], 4).alias("east"),
        F.round(high["lat"], 4).alias("north"),
    )


@_query("select o_orderkey, split_part(p, '/', 2) as folder, split_part(p, '/', -1) as leaf from (select o_orderkey, 'img/' || o_orderstatus || '/' || o_orderkey as p from orders)")
def h3_path_part(spark, sf):
    p = F.concat(F.lit("img/"), "o_orderstatus", F.lit("/"), F.col("o_orderkey").cast("string"))
    return X.table(spark, sf, "orders").withColumn("p", p).select("o_orderkey", S.path_part("p", 2).alias("folder"), S.path_part("p").alias("leaf"))


@_query()
def h12_utm_points(spark, sf):
    """Stations in degrees to metres and back; the way back must meet the start."""
    k = F.col("c_custkey")
    rows = X.table(spark, sf, "customer").select("c_custkey", (F.lit(-75.0) + (k % 600) / 100 - 3).alias("lon"), (F.lit(20.0) + (k % 4000) / 100).alias("lat"))
    x, y = S.lonlat_to_utm("lon", "lat", 18)
    there = rows.withColumns({"x": x, "y": y})
    lon, lat = S.utm_to_lonlat("x", "y", 18)
    back = (F.abs(lon - F.col("lon")) < 1e-7) & (F.abs(lat - F.col("lat")) < 1e-7)
    return there.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), back.alias("returns"))
