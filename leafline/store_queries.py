"""Registered queries of stores that are taken up again, result pages, smoothed density and layers of a whole product, and DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import catalog, matchup, mosaic, product, series
from .plans import fixtures as X
from .plans import phenology as P
from .plans.fixtures import PARAMS
from .queries import BY, CELL, _query
from .sources import tables as T

_CHUNK = "cast(least(floor((cell-1) / greatest(floor((select count(*) from supplier) / 20), 1)), 19) + 1 as bigint)"


@_query(
    f"""select chunk, case when chunk in (3, 11) then 'written' else 'kept' end as state, count(*) as n_rows, count(*) as stored
 from (select {_CHUNK} as chunk from daily) group by chunk""",
    "daily",
)
def d17_resume_chunks(spark, sf):
    """All chunks are written; one then loses half of its rows and one all of them; a second run mends just these."""
    n, path = X.table(spark, sf, "supplier").count(), T.scratch_path(spark, "resumed")
    chunks = mosaic.chunked(mosaic.daily_pipeline(X.obs(spark, sf)), 20, n).withColumn("chunk", F.col("chunk").cast("long"))
    T.resume_chunks(chunks, path)
    halved = chunks.where((F.col("chunk") == 3) & (F.dayofmonth("obs_date") % 2 == 0) | (F.col("chunk") == 11) & F.lit(False))
    lost = halved.unionByName(chunks.where("chunk = 11").limit(1))
    lost.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
    told = T.resume_chunks(chunks, path)
    stored = T.stored(spark, path, chunks.schema).groupBy("chunk").agg(F.count("*").alias("stored"))
    return told.join(stored, "chunk").select("chunk", "state", "n_rows", "stored")


_PAGES = """with recursive own as (select o_custkey as c, o_orderkey as k, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt,
  row_number() over (partition by o_custkey order by o_orderkey) as i, min(o_orderkey) over (partition by o_custkey) as first from orders),
 second as (select c, k from own where i = 2),
 pages as (select 'p' || k as page, case when k % 97 = 0 then 'gone' || k when nxt is not null then 'p' || nxt when own.c % 50 = 1 then 'p' || (select s.k from second s where s.c = own.c) end as next
  from own),
 starts as (select distinct 'p' || first as start from own),
 chain as (select start, 0 as seq, start as page, [start] as seen, 'read' as state from starts
  union all select c.start, c.seq + 1, p.next, list_append(c.seen, p.next),
   case when list_contains(c.seen, p.next) then 'circle' when not exists (select 1 from pages q where q.page = p.next) then 'lost' else 'read' end
  from chain c join pages p on p.page = c.page where c.state = 'read' and p.next is not null)"""


@_query(_PAGES + " select start, cast(seq as bigint) as seq, page, state from chain")
def a7_page_chains(spark, sf):
    """Each customer's orders as a chain of stored result pages; some links lead to pages that aren't there, some back."""
    path = T.scratch_path(spark, "result-pages")
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    each = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    rows = each.select("c", F.get("ks", F.lit(0)).alias("first"), F.get("ks", F.lit(1)).alias("second"), "ks", F.posexplode("ks").alias("i", "k"))
    rows = rows.withColumn("nxt", F.get("ks", F.col("i") + 1))
    link = F.when(F.col("k") % 97 == 0, F.concat(F.lit("gone"), F.col("k").cast("string"))).when(F.col("nxt").isNotNull(), name("nxt"))
    link = link.when(F.col("c") % 50 == 1, name("second"))
    features = F.array(F.struct(F.col("k").cast("string").alias("id")))
    rows.select(F.struct(name("k").alias("_self"), link.alias("_next")).alias("_links"), features.alias("features")).write.json(path)
    starts = each.select(F.get("ks", F.lit(0)).alias("first")).select(name("first").alias("start"))
    return catalog.follow_pages(T.scan_pages(spark, path), starts)


@_query(
    """with bins as (select cast(least(floor((l_quantity-0)*50/50.0),49) as bigint) as bx, cast(least(floor((l_extendedprice-0)*50/110000.0),49) as bigint) as qy, count(*) as n
  from lineitem where l_quantity between 0 and 50 and l_extendedprice between 0 and 110000 group by 1, 2),
 h as (select (quantile_cont(cast(l_quantity as double), 0.95) - quantile_cont(cast(l_quantity as double), 0.05)) / 25 as hx, (quantile_cont(cast(l_extendedprice as double), 0.95) - quantile_cont(cast(l_extendedprice as double), 0.05)) / 25 as hy from lineitem),
 r as (select hx, hy, cast(floor(3.4 * hx / 1.0) as bigint) as rx, cast(floor(3.4 * hy / 2200.0) as bigint) as ry from h),
 moved as (select bx + i as bx, qy + j as qy, n * exp(-0.5 * (i * 1.0 / hx) ** 2) / (hx * sqrt(2 * pi())) * exp(-0.5 * (j * 2200.0 / hy) ** 2) / (hy * sqrt(2 * pi())) as v
  from bins, r, lateral (select unnest(range(-rx, rx + 1)) as i), lateral (select unnest(range(-ry, ry + 1)) as j))
 select bx, qy as "by", round(sum(v) / (select sum(n) from bins) * 1e6, 6) as density from moved where bx between 0 and 49 and qy between 0 and 49 group by 1, 2"""
)
def d14_smoothed_density(spark, sf):
    pairs = X.table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    hx, hy = matchup.bandwidths(pairs, ["x", "y"])
    counts = matchup.density_2d(pairs, "x", "y", 0.0, 50.0, 0.0, 110000.0, 50)
    smoothed = matchup.smoothed_density(counts, 1.0, 2200.0, hx, hy, 50)
    return smoothed.select("bx", "by", F.round(F.col("density") * 1e6, 6).alias("density"))


@_query(
    """with r as (select o_custkey % 200 as order_name, o_orderkey as item, case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'skipped' end as state,
  case when o_custkey % 200 % 11 = 0 then 'running' else 'success' end as delivery from orders),
 each as (select order_name, count_if(state = 'success') as success, count_if(state = 'failed') as failed, count_if(state = 'skipped') as skipped, count_if(delivery <> 'success') as undelivered,
  string_agg(case when state = 'failed' then item end, ',' order by item) as items from r group by order_name)
 select order_name, success, failed, skipped, undelivered, coalesce(items, '') as failed_items, cast(null as varchar) as failed_orders from each
 union all select null, sum(success)::bigint, sum(failed)::bigint, sum(skipped)::bigint, sum(undelivered)::bigint, null, string_agg(case when failed > 0 then order_name end, ',' order by order_name) from each"""
)
def d13_failed_items(spark, sf):
    status, name = F.col("o_orderstatus"), F.col("o_custkey") % 200
    state = F.when(status == "F", "success").when(status == "O", "failed").otherwise("skipped")
    rows = X.table(spark, sf, "orders").select(
        name.alias("order_name"), F.col("o_orderkey").alias("item"), state.alias("state"), F.when(name % 11 == 0, "running").otherwise("success").alias("delivery")
    )
    out = catalog.download_summary(rows, item="item", ordered="delivery")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("order_name", "success", "failed", "skipped", "undelivered", text("failed_items"), text("failed_orders"))


def _layers(spark, sf):
    """All 24 layers of cells and years, from what a year was like: values in and out of range, and unknown ones."""
    yearly = X.series(spark, sf).where("vi is not null").groupBy(*CELL, F.year("obs_date").alias("year"))
    yearly = yearly.agg(F.count("*").alias("n"), F.dayofyear(F.min("obs_date")).alias("a"), F.round(F.max("vi") * 10000).alias("hi"))
    value = lambda i: F.when((F.col("n") + i) % 7 != 0, F.col("a") * (i + 1) + F.when(F.lit(i % 3 == 1), F.col("hi")).otherwise(0)).cast("double")
    return product.to_long(yearly.select(*BY, *(value(i).alias(c) for i, c in enumerate(product.LAYER_NAMES))), BY)


_RANGES = ", ".join(f"({row[0]}, '{row[1]}', {int(row[5])}, {int(row[6])}, '{row[3]}')" for row in product.LAYERS)


@_query(
    f""", y as (select site_id, cell, cast(year(obs_date) as int) as year, count(*) as n, dayofyear(min(obs_date)) as a, round(max(vi)*10000) as hi from good group by all),
 l as (select *, lyr - 1 as i from y, (values {_RANGES}) r(lyr, short_name, lo, top, units)),
 v as (select *, case when (n + i) % 7 <> 0 then a * lyr + case when i % 3 = 1 then hi else 0 end end as val from l)
 select year, short_name, any_value(units) as units, count(*) as n, cast(sum(case when val between lo and top then trunc(val) else 32767 end) as bigint) as total from v group by all""",
    "good",
)
def a13_write_layers_of_product(spark, sf):
    """All layers are packed, written and read back; the units are those of the columns' metadata in the files."""
    path = T.scratch_path(spark, "whole-product")
    T.write_product(product.pack(_layers(spark, sf)).select(*BY, "short_name", "packed"), path, {"title": "layers"})
    back = spark.read.parquet(path)
    units = {f.name: f.metadata.get("units", "") for f in back.schema.fields if f.name in product.LAYER_NAMES}
    if back.schema[CELL[0]].metadata != {"title": "layers"}:
        raise ValueError("the product's attributes are lost")
    long = product.to_long(back.withColumn("year", F.col("year").cast("int")), BY)
    named = F.create_map(*(F.lit(x) for pair in units.items() for x in pair))
    return long.groupBy("year", "short_name").agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("total")).withColumn("units", F.element_at(named, F.col("short_name")))


@_query("select cell, cast(s_suppkey % 101 as double) as occ from (select s_suppkey as cell, s_suppkey from supplier)")
def a8_scan_water(spark, sf):
    path = T.scratch_path(spark, "water-scan")
    X.water(spark, sf).withColumn("more", F.lit("x")).write.parquet(path)
    return T.scan_water(spark, path)


@_query(
    """select v.site_id, v.cell, v.obs_date, g.n > 0 as in_gap from good v join lateral (select count(*) as n from gaps g where g.site_id = v.site_id and g.cell = v.cell
 and v.obs_date + 3 >= g.gap_start and v.obs_date + 3 < g.gap_end) g on true""",
    "good", "gaps",
)
def e4_in_gap(spark, sf):
    """Whether the third day after each observation lies in a gap."""
    s = X.series(spark, sf).where("vi is not null")
    gaps = series.gap_islands(s)
    own = gaps.groupBy(*CELL).agg(F.collect_list(F.struct("gap_start", "gap_end")).alias("gaps"))
    day = F.date_add("obs_date", 3)
    rows = s.join(own, CELL, "left")
    return rows.select(*CELL, "obs_date", F.coalesce(F.exists("gaps", lambda g: (g["gap_start"] <= day) & (day < g["gap_end"])), F.lit(False)).alias("in_gap"))


@_query()
def k17_explain_stored(spark, sf):
    """The chain of the cells of one chunk in twenty, from the stored chunks alone: other chunks aren't read."""
    path, n = T.scratch_path(spark, "explained"), X.table(spark, sf, "supplier").count()
    T.write_chunks(mosaic.chunked(X.series(spark, sf), 20, n), path)
    cells = list(range(1, max(2, n // 20)))
    out = P.explain_stored(spark, path, X.water(spark, sf), cells, 20, n, PARAMS)
    return out.select(*BY, F.round("EVImax", 3).alias("EVImax"), "NumCycles", F.size("curve").alias("n_slots"), F.size("days").alias("n_days"))


@_query("select site_id, cell, count(*) as n, count(vi) as clear, round(avg(vi), 6) as mean_vi from vi group by site_id, cell", "vi")
def a11_bucketed_cells(spark, sf):
    """The series as a table in buckets of its cells; grouping by cell then needs no shuffle."""
    path = T.scratch_path(spark, "cells")
    name = f"cells_{path.rpartition('-')[2]}"
    T.write_cells(X.series(spark, sf), name, path, 16)
    return spark.table(name).groupBy(*CELL).agg(F.count("*").alias("n"), F.count("vi").alias("clear"), F.round(F.avg("vi"), 6).alias("mean_vi"))
