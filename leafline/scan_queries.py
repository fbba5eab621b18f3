"""Registered queries of the scans of CSV, GeoJSON, station files and file lists, and DuckDB SQL with the same rows.

The given tables hold no such files, so each query first writes them from a table, many records a
file, to the shared folder, and then scans them. A file holds a bounded run of ids, so that more
rows give more files and none grows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import masks, mosaic, product
from .plans import fixtures as X
from .queries import _query
from .source_queries import _ANNUAL, _annual
from .sources import tables as T

#: Lines before the data in a file of transition dates.
PREAMBLE = 16
#: Ids in one written file.
RUN = 1000


def _one_row_a_file(df):
    return df.write.option("maxRecordsPerFile", 1)


@_query(
    "select distinct cast(site_id as int) as site_id, cast(year(obs_date) as int) as year from daily", "daily"
)
def a2_scan_file_index(spark, sf):
    """The sink gives files to each site and year, several where there are many rows."""
    path = T.scratch_path(spark, "indexed")
    T.write_daily(mosaic.daily_pipeline(X.obs(spark, sf)), path)
    part = lambda name: F.regexp_extract("path", f"{name}=([0-9]+)", 1).cast("int").alias(name)
    files = T.scan_file_index(spark, path, "part-*.parquet").select(part("site_id"), part("year"))
    return files.distinct()


@_query("select 'cell ' || cell as site, round(x, 4) as c_lon, round(y, 4) as c_lat from grid", "grid")
def a3_scan_sites(spark, sf):
    """Cells go out as GeoJSON squares, a collection for each run of ids; their centroids are the cells' centres."""
    path = T.scratch_path(spark, "sites")
    at = lambda i, j: F.array(F.col("x") + 1.5 * i, F.col("y") + 1.5 * j)
    ring = F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))
    name = F.concat(F.lit("cell "), F.col("cell").cast("string"))
    feature = F.struct(F.struct(name.alias("name")).alias("properties"), F.struct(F.array(ring).alias("coordinates")).alias("geometry"))
    runs = X.grid(spark, sf).groupBy(F.floor(F.col("cell") / RUN).alias("run")).agg(F.collect_list(feature).alias("features"))
    _one_row_a_file(runs.select("features")).json(path)
    return T.site_centroid(T.scan_sites(spark, path)).select("site", F.round("c_lon", 4).alias("c_lon"), F.round("c_lat", 4).alias("c_lat"))


@_query(
    _ANNUAL
    + """ select case short_name when 'EVImax' then 9 when 'EVIamp' then 10 else 11 end as product_lyr, short_name, count(*) as n, round(max(val), 4) as hi
 from l group by all""",
    "curve",
)
def a4_scan_layer_catalog(spark, sf):
    """The catalog as read from CSV, joined to the layers of all cells and years."""
    path = T.scratch_path(spark, "catalog-csv")
    product.layer_catalog(spark).write.option("header", True).csv(path)
    layers = T.scan_layer_catalog(spark, path).select("product_lyr", "short_name")  # 24 rows
    joined = _annual(spark, sf).join(F.broadcast(layers), "short_name")
    return joined.groupBy("product_lyr", "short_name").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("hi"))


@_query(
    """select case o_orderstatus when 'F' then 'rising' else 'falling' end as direction, cast(year(o_orderdate) as int) as year, count(*) as n,
 min(cast(o_orderdate as date)) as first_day from orders where o_orderstatus in ('F', 'O') and o_orderpriority like '1%' group by all"""
)
def a5_scan_csv_skip(spark, sf):
    """Orders go out as files of transition dates with their preamble, and come back without it."""
    path = T.scratch_path(spark, "transitions")
    status = F.col("o_orderstatus")
    line = F.concat_ws(
        ",", F.when(status == "F", "rising").when(status == "O", "falling").otherwise("none"),
        F.when(F.col("o_orderpriority").startswith("1"), "gcc_90").otherwise("gcc_50"), F.date_format("o_orderdate", "yyyy-MM-dd"),
    )
    runs = X.table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / RUN).alias("run")).agg(F.collect_list(line).alias("lines"))
    preamble = F.array_repeat(F.lit("# transition dates"), PREAMBLE)
    _one_row_a_file(runs.select(F.array_join(F.concat(preamble, "lines"), "\n").alias("value"))).text(path)
    rows = T.scan_csv_skip(spark, path, PREAMBLE, "direction string, gcc_value string, day date")
    kept = masks.point_filter(rows, ("rising", "falling"), "gcc_value", "gcc_90")
    return kept.groupBy("direction", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


@_query(
    """select case when s_nationkey % 2 = 0 then 'DB' else 'EN' end as veg, count(*) as n, round(min(20.0 + (s_suppkey % 4000) / 100.0), 4) as south,
 round(max(20.0 + (s_suppkey % 4000) / 100.0), 4) as north from supplier group by all"""
)
def a6_scan_station_meta(spark, sf):
    """Suppliers go out as stations' nested JSON documents, one a line."""
    path = T.scratch_path(spark, "stations")
    k = F.col("s_suppkey")
    station = F.struct(
        F.col("s_name").alias("sitename"), F.col("s_name").alias("long_name"), (20.0 + (k % 4000) / 100).alias("lat"), (-75.0 + (k % 600) / 100).alias("lon"),
        F.lit(100.0).alias("elevation"), F.when(F.col("s_nationkey") % 2 == 0, "DB").otherwise("EN").alias("primary_veg_type"),
        F.lit("2016-01-01").alias("date_start"), F.lit("2021-12-31").alias("date_end"),
    )
    X.table(spark, sf, "supplier").select(station.alias("phenocam_site")).write.json(path)
    found = T.scan_station_meta(spark, path, a_line_each=True).groupBy(F.col("primary_veg_type").alias("veg"))
    return found.agg(F.count("*").alias("n"), F.round(F.min("lat"), 4).alias("south"), F.round(F.max("lat"), 4).alias("north"))


@_query(
    """select c_mktsegment as veg, count(*) as n, count(distinct 'US-' || (c_custkey % 97)) as n_codes
 from orders join customer on o_custkey = c_custkey group by c_mktsegment"""
)
def a9_scan_site_table(spark, sf):
    """The site table as read from CSV, looked up by every order's site."""
    path = T.scratch_path(spark, "site-list")
    k = F.col("c_custkey").cast("string")
    code = F.concat(F.lit("US-"), (F.col("c_custkey") % 97).cast("string"))
    sites = X.table(spark, sf, "customer").select(F.concat(F.lit("site"), k).alias("site"), code.alias("flux_code"), F.col("c_mktsegment").alias("veg"))
    sites.write.option("header", True).csv(path)
    seen = X.table(spark, sf, "orders").select(F.concat(F.lit("site"), F.col("o_custkey").cast("string")).alias("site"))
    found = seen.join(T.scan_site_table(spark, path), "site")
    return found.groupBy("veg").agg(F.count("*").alias("n"), F.count_distinct("flux_code").alias("n_codes"))


@_query("select event_type, count(*) as n, round(avg(value), 6) as mean from events where value is not null and user_id is not null group by event_type")
def b17_drop_incomplete(spark, sf):
    rows = masks.drop_incomplete(X.table(spark, sf, "events"), ["value", "user_id"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@_query("select event_type, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as total, count(*) as n from events group by event_type")
def h17_nested_properties(spark, sf):
    rows = X.table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@_query(
    "select cell, round(((x - 500001.5) / 3 - col) + 2, 6) as two, cast(prev as int) as prev, cast(inside as int) as inside, cast(next as int) as next "
    "from (select *, cell % 735 + 1 <= 185 as prev, cell % 735 + 1 between 186 and 550 as inside, cell % 735 + 1 > 550 as next from grid)",
    "grid",
)
def b10_slots_of_years(spark, sf):
    slot = F.col("cell") % 735 + 1
    two = (F.col("x") - 500001.5) / 3 - F.col("col") + 2
    return X.grid(spark, sf).select(
        "cell", F.round(two, 6).alias("two"), S.prev_year(slot).cast("int").alias("prev"), S.in_year(slot).cast("int").alias("inside"),
        S.next_year(slot).cast("int").alias("next"),
    )
