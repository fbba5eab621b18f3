"""Registered queries of the phenology operators, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import catalog, cycles, despike, masks, matchup, mosaic, product, resample, series, similarity, spline
from .plans import fixtures as X
from .plans import phenology as P
from .plans.fixtures import PARAMS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CELL = ["site_id", "cell"]
BY = [*CELL, "year"]

_CTES = {
    "obs": """select n.n_regionkey as site_id, l.l_suppkey as cell, l.l_orderkey*10+l.l_linenumber as scene_id, cast(l.l_shipdate as date) as obs_date,
 cast(300+2*l.l_quantity+case when round(l.l_discount*100)=10 then 1500 else 0 end as int) as blue,
 cast(500+3*l.l_quantity as int) as green,
 cast(900-4*greatest(0,150-abs(dayofyear(cast(l.l_shipdate as date))-197))+l.l_quantity+case when round(l.l_discount*100)=10 then 1500 else 0 end as int) as red,
 cast(1500+18*greatest(0,150-abs(dayofyear(cast(l.l_shipdate as date))-197))+5*l.l_quantity+case when round(l.l_discount*100)=10 then 300 else 0 end as int) as nir,
 case when l.l_returnflag='N' then null when round(l.l_tax*100)=8 then 1 else 0 end as udm,
 case when l.l_linestatus='O' then null when round(l.l_discount*100)=9 then 0 else 1 end as udm2
from lineitem l join supplier s on l.l_suppkey=s.s_suppkey join nation n on s.s_nationkey=n.n_nationkey""",
    "flagged": "select *, udm is not null and (udm > 0 or (udm2 is not null and udm2 <> 1)) as bad from obs",
    "masked": """select site_id, cell, scene_id, obs_date, case when not bad then blue end as blue, case when not bad then green end as green,
 case when not bad then red end as red, case when not bad then nir end as nir from flagged""",
    "daily": "select site_id, cell, obs_date, avg(blue) as blue, avg(green) as green, avg(red) as red, avg(nir) as nir from masked group by all",
    "refl": "select site_id, cell, obs_date, blue/10000 as blue, green/10000 as green, red/10000 as red, nir/10000 as nir from daily",
    "vi": "select *, 2.5*(nir-red)/(nir+2.4*red+1.0) as vi from refl",
    "good": "select * from vi where vi is not null",
    "years": """select y::int as year, cast(make_date(y, 1, 1) - 185 as date) as win_start, cast(make_date(y, 1, 1) - 185 + 734 as date) as win_end
 from (values (1996), (1997), (1998), (1999), (2000)) t(y)""",
    "gaps": """select * from (select site_id, cell, lag(obs_date) over (partition by site_id, cell order by obs_date) as gap_start, obs_date as gap_end from good)
 where gap_end - gap_start > 20""",
    "seg": """select site_id, cell, obs_date as d1, vi as v1, lead(obs_date) over w as d2, lead(vi) over w as v2 from good window w as (partition by site_id, cell order by obs_date)""",
    "curve": """select site_id, cell, slot_date, round(case when d2 is null then v1 else 0.0 + v1 * 0 + (v1 + (v2-v1) * cast(slot_date-d1 as double)/cast(d2-d1 as double)) end, 6) as vi
 from (select *, unnest(generate_series(d1, case when d2 is null then d1 else cast(d2 - 1 as date) end, interval 1 day))::date as slot_date from seg)""",
    "slots": "select c.site_id, c.cell, y.year, c.slot_date - y.win_start + 1 as day_idx, c.vi as v from curve c join years y on c.slot_date between y.win_start and y.win_end",
    "items": """select o_orderkey as item_id, o_custkey % 50 as cell_group, cast(o_orderdate as date) as acquired, cast(o_orderkey % 100 as double)/100 as cloud_cover,
 case when o_orderstatus='F' then 'standard' else 'test' end as quality_category, (o_orderkey % 7) <> 0 as ground_control from orders""",
    "grid": "select s_suppkey as cell, s_suppkey // 10 as row, s_suppkey % 10 as col, 500001.5 + 3*(s_suppkey % 10) as x, 4000001.5 - 3*(s_suppkey // 10) as y from supplier",
    "water": "select s_suppkey as cell, cast(s_suppkey % 101 as double) as occ from supplier",
}
_NEEDS = {
    "flagged": "obs", "masked": "flagged", "daily": "masked", "refl": "daily", "vi": "refl", "good": "vi", "gaps": "good", "seg": "good", "curve": "seg",
    "slots": "curve years",
}


def _with(final: str, *names: str) -> str:
    need: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, "").split():
            add(m)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as ({_CTES[n]})" for n in need) + " " + final.lstrip() if need else final


def _query(sql: str | None = None, *ctes: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _with(sql, *ctes)
        return f

    return register


def _r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# masks, reflectance, mosaics


@_query("select site_id, count(blue) as n_blue, cast(sum(red) as bigint) as sum_red, count(*) as n from masked group by site_id", "masked")
def b3_qa_mask(spark, sf):
    return masks.apply_qa_mask(X.obs(spark, sf)).groupBy("site_id").agg(
        F.count("blue").alias("n_blue"), F.sum("red").alias("sum_red"), F.count("*").alias("n")
    )


@_query("select site_id, count(*) as n from obs where case when udm is null and udm2 is null then 3 else 4 end = 4 group by site_id", "obs")
def b4_four_bands(spark, sf):
    bands = F.when(F.col("udm").isNull() & F.col("udm2").isNull(), 3).otherwise(4)
    return masks.require_four_bands(X.obs(spark, sf).withColumn("n_bands", bands)).groupBy("site_id").agg(F.count("*").alias("n"))


@_query("select cell, x, y from grid where x between 500010.0 - 9 and 500010.0 + 9 and y between 3999990.0 - 9 and 3999990.0 + 9", "grid")
def b5_crop_window(spark, sf):
    return masks.crop_window(X.grid(spark, sf), 500010.0, 3999990.0, 9.0).select("cell", "x", "y")


@_query(
    """select o.scene_id, m.udm from obs o left join (select scene_id // 10 as k, any_value(udm) as udm from obs where udm is not null
 group by 1 having count(*) = 1) m on o.scene_id // 10 = m.k""",
    "obs",
)
def c1_join_masks(spark, sf):
    """An order's lines share a key, so that scenes have no mask, one or several."""
    o = X.obs(spark, sf).withColumn("scene_key", F.floor(F.col("scene_id") / 10))
    found = masks.join_masks(o.drop("udm", "udm2"), o.select("scene_key", "udm").where("udm is not null"))
    return found.select("scene_id", "udm")


@_query("select site_id, cell, obs_date, round(red,6) as red, round(nir,6) as nir from daily", "daily")
def d1_daily_mosaic(spark, sf):
    return mosaic.daily_mosaic(masks.apply_qa_mask(X.obs(spark, sf))).select(*CELL, "obs_date", *_r6("red", "nir"))


@_query("select site_id, cell, obs_date, round(blue,6) as blue, round(vi,6) as vi from vi", "vi")
def b2_evi2(spark, sf):
    return X.series(spark, sf).select(*CELL, "obs_date", *_r6("blue", "vi"))


@_query(
    """select site_id, cell, cast(year(obs_date) as int) as year, count(vi) as clear_days, round(min(vi),6) as lo, round(max(vi),6) as hi, round(avg(vi),6) as mean_vi
 from vi group by all""",
    "vi",
)
def k18_daily_pipeline(spark, sf):
    return X.series(spark, sf).groupBy(*CELL, F.year("obs_date").alias("year")).agg(
        F.count("vi").alias("clear_days"), F.round(F.min("vi"), 6).alias("lo"), F.round(F.max("vi"), 6).alias("hi"), F.round(F.avg("vi"), 6).alias("mean_vi")
    )


@_query("select site_id, cell, count(*) as n, min(obs_date) as first_date, max(obs_date) as last_date, round((array_agg(red order by obs_date))[1],6) as first_red from daily group by all", "daily")
def k19_pixel_arrays(spark, sf):
    s = F.col("series")
    return mosaic.to_pixel_arrays(mosaic.daily_pipeline(X.obs(spark, sf))).select(
        *CELL, F.size(s).cast("long").alias("n"), s[0]["obs_date"].alias("first_date"), F.element_at(s, -1)["obs_date"].alias("last_date"),
        F.round(s[0]["red"], 6).alias("first_red"),
    )


@_query(
    """, cells as (select n.n_regionkey as site_id, s.s_suppkey as cell from supplier s join nation n on s.s_nationkey = n.n_nationkey)
 select d.site_id, d.obs_date, count(*) as n_cells, count(m.red) as n_seen from cells g join (select distinct site_id, obs_date from daily) d using (site_id)
 left join daily m on m.site_id = d.site_id and m.cell = g.cell and m.obs_date = d.obs_date group by all""",
    "daily",
)
def c2_align_to_grid(spark, sf):
    grid = X.site_cells(spark, sf).select(F.col("site").alias("site_id"), "cell")
    aligned = mosaic.align_to_grid(mosaic.daily_pipeline(X.obs(spark, sf)), grid)
    return aligned.groupBy("site_id", "obs_date").agg(F.count("*").alias("n_cells"), F.count("red").alias("n_seen"))


@_query(
    """with images as (select s_suppkey as scene_id, n_regionkey as site_id, 500000.0 + s_suppkey % 7 * 0.9 - 4 as ox, 4000000.0 - s_suppkey % 5 * 1.3 as oy, case when s_suppkey % 3 = 0 then 3.0 else 3.7 end as res
  from supplier join nation on s_nationkey = n_nationkey),
 pixels as (select l_suppkey as scene_id, l_orderkey % 12 as row, l_linenumber * 2 + l_orderkey // 12 % 2 as col, avg(l_quantity) as red, avg(case when l_quantity > 10 then l_tax end) as nir from lineitem group by all),
 cells as (select r as row, c as col, 500000.0 + (c + 0.5) * 3.0 as x, 4000000.0 - (r + 0.5) * 3.0 as y from range(15) a(r), range(16) b(c)),
 near as (select i.scene_id, i.site_id, row * 16 + col + 1 as cell, (x - ox) / res - 0.5 as u, (oy - y) / res - 0.5 as v from images i, cells),
 four as (select *, floor(u) + du as pc, floor(v) + dv as pr, (case when du = 0 then 1 - (u - floor(u)) else u - floor(u) end) * (case when dv = 0 then 1 - (v - floor(v)) else v - floor(v) end) as w
  from near, (values (0), (1)) a(du), (values (0), (1)) b(dv)),
 found as (select f.site_id, f.scene_id, f.cell, sum(w * red) / sum(w) filter (red is not null) as red, sum(w * nir) / sum(w) filter (nir is not null) as nir
  from four f join pixels p on p.scene_id = f.scene_id and p.row = f.pr and p.col = f.pc where w > 1e-12 group by all)
 select site_id, scene_id, count(*) as n_cells, count(nir) as n_nir, sum(cell)::bigint as cells, round(sum(red), 4) as red, round(max(red), 6) as top, round(sum(nir), 6) as nir from found group by all"""
)
def c2_resample(spark, sf):
    """Images of 3 and 3.7 m, shifted against a base grid of 3 m; some pixels are missing, some bands null."""
    s, l, o = F.col("s_suppkey"), F.col("l_linenumber"), F.col("l_orderkey")
    regions = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("site_id"))
    images = X.table(spark, sf, "supplier").join(regions, "s_nationkey").select(
        s.alias("scene_id"), "site_id", (500000.0 + s % 7 * 0.9 - 4).alias("ox"), (4000000.0 - s % 5 * 1.3).alias("oy"),
        F.when(s % 3 == 0, 3.0).otherwise(3.7).alias("res"), F.lit(19).alias("zone"),
    )
    by = (F.col("l_suppkey").alias("scene_id"), (o % 12).alias("row"), (l * 2 + F.floor(o / 12) % 2).alias("col"))
    pixels = X.table(spark, sf, "lineitem").groupBy(*by).agg(F.avg("l_quantity").alias("red"), F.avg(F.when(F.col("l_quantity") > 10, F.col("l_tax"))).alias("nir"))
    bases = X.table(spark, sf, "nation").select(F.col("n_regionkey").alias("site_id")).distinct().select(
        "site_id", F.lit(500000.0).alias("bx"), F.lit(4000000.0).alias("by"), F.lit(3.0).alias("bres"), F.lit(19).alias("bzone"), F.lit(15).alias("n_rows"), F.lit(16).alias("n_cols")
    )
    out = resample.resample(pixels, images, bases, ("red", "nir")).groupBy("site_id", "scene_id")
    return out.agg(
        F.count("*").alias("n_cells"), F.count("nir").alias("n_nir"), F.sum("cell").alias("cells"), F.round(F.sum("red"), 4).alias("red"),
        F.round(F.max("red"), 6).alias("top"), F.round(F.sum("nir"), 6).alias("nir"),
    )


@_query(
    """select chunk, count(distinct obs_date) as n_dates, count(distinct obs_date) = (select count(distinct obs_date) from daily) as complete
 from (select *, cast(least(floor((cell-1) / greatest(floor((select count(*) from supplier) / 20), 1)), 19) + 1 as bigint) as chunk from daily) group by chunk""",
    "daily",
)
def d17_chunk_completeness(spark, sf):
    n = X.table(spark, sf, "supplier").count()
    return mosaic.chunk_completeness(mosaic.chunked(mosaic.daily_pipeline(X.obs(spark, sf)), 20, n))


@_query(
    """select cast(r as bigint) as row, cast(c as bigint) as col, x0 + 3.0*c as x, y1 - 3.0*r as y
 from (select min(x) as x0, max(y) as y1, cast(round((max(y)-min(y))/3) as bigint) as nr, cast(round((max(x)-min(x))/3) as bigint) as nc from grid),
 lateral (select unnest(generate_series(0, nr)) as r), lateral (select unnest(generate_series(0, nc)) as c)""",
    "grid",
)
def d16_grid_extent(spark, sf):
    return mosaic.grid_extent(X.grid(spark, sf), 3.0).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "x", "y")


@_query(
    """, inside as (select cell from grid where x between 500013.0 - 9 and 500013.0 + 9 and y between 3999990.0 - 9 and 3999990.0 + 9),
 days as (select cell, obs_date, avg(case when not bad then red end) as red from flagged join inside using (cell) where not (udm is null and udm2 is null) group by all)
 select i.cell, d.obs_date, round(m.red, 6) as red from inside i cross join (select distinct obs_date from days) d left join days m on m.cell = i.cell and m.obs_date = d.obs_date""",
    "flagged", "grid",
)
def k18_scene_pipeline(spark, sf):
    """Scenes without any mask count as those that lack a band."""
    bands = F.when(F.col("udm").isNull() & F.col("udm2").isNull(), 3).otherwise(4)
    grid = X.grid(spark, sf).select("cell", "x", "y")
    scenes = X.obs(spark, sf).withColumn("n_bands", bands).join(grid, "cell")
    return mosaic.scene_pipeline(scenes, grid, 500013.0, 3999990.0, 9.0).select("cell", "obs_date", *_r6("red"))


# series


@_query(
    """select site_id, cell, obs_date, round(lag(vi) over w,6) as prev_value, lag(obs_date) over w as prev_date, lead(obs_date) over w as next_date
 from good window w as (partition by site_id, cell order by obs_date)""",
    "good",
)
def e1_triplets(spark, sf):
    return series.triplets(X.series(spark, sf)).select(*CELL, "obs_date", *_r6("prev_value"), "prev_date", "next_date")


@_query(
    """select site_id, cell, obs_date, round(vi - lag(vi) over w,6) + 0.0 as d_value, cast(obs_date - lag(obs_date) over w as int) as d_days
 from good window w as (partition by site_id, cell order by obs_date)""",
    "good",
)
def e2_diff_series(spark, sf):
    return series.diff_series(X.series(spark, sf).where("vi is not null"), "vi").withColumn("d_value", F.round("d_value", 6) + F.lit(0.0))


@_query("select * from gaps", "gaps")
def e3_gap_islands(spark, sf):
    return series.gap_islands(X.series(spark, sf))


@_query("select site_id, cell, unnest(generate_series(greatest(gap_start, date '1996-01-01'), least(gap_end - 1, date '2000-12-31'), interval 1 day))::date as slot_date from gaps where gap_end > date '1996-01-01' and gap_start <= date '2000-12-31'", "gaps")
def k6_gap_slots(spark, sf):
    return series.gap_slots(X.series(spark, sf), "1996-01-01", "2000-12-31")


@_query("select distinct site_id, cell, year from gaps join years on gap_start <= win_end and gap_end > win_start", "gaps", "years")
def c6_years_with_gaps(spark, sf):
    return series.years_with_gaps(X.series(spark, sf), PARAMS.years)


@_query("select site_id, cell, min(obs_date) as first_valid, max(obs_date) as last_valid from good group by all", "good")
def e6_first_last_valid(spark, sf):
    return series.first_last_valid(X.series(spark, sf))


@_query(
    """select site_id, cell, cast(date '1995-06-30' + (b*3 + 1) as date) as obs_date, round(max(vi),6) as vi from
 (select *, cast(floor((obs_date - date '1995-06-30')/3) as int) as b from good where obs_date between date '1995-06-30' and date '2001-07-04') group by site_id, cell, b""",
    "good",
)
def d2_three_day_composite(spark, sf):
    return series.three_day_composite(X.series(spark, sf), "1995-06-30", "2001-07-04").withColumn("vi", F.round("vi", 6))


@_query("select site_id, cell, round(quantile_cont(vi, 0.05) filter (where vi > 0 and obs_date between date '1996-01-01' and date '2000-12-31'),6) as dormant from good group by all", "good")
def d3_dormant_value(spark, sf):
    return series.dormant_value(X.series(spark, sf), "1996-01-01", "2000-12-31").withColumn("dormant", F.round("dormant", 6))


@_query(
    """select v.site_id, v.cell, v.obs_date, round(q.d,6) as dormant, round(case when v.vi < q.d then q.d else v.vi end,6) as vi from vi v join
 (select site_id, cell, quantile_cont(vi, 0.05) filter (where vi > 0 and obs_date between date '1996-01-01' and date '2000-12-31') as d from vi group by all) q using (site_id, cell)""",
    "vi",
)
def k3_floor_dormant(spark, sf):
    return series.floor_dormant(X.series(spark, sf), "1996-01-01", "2000-12-31").select(*CELL, "obs_date", *_r6("dormant", "vi"))


@_query(
    """select s.site_id, s.cell, round(s.share,6) as negative_share, coalesce(w.occ, 0) as occ, s.share > 0.01 and coalesce(w.occ,0) > 30 as is_water
 from (select site_id, cell, avg(case when vi < 0 then 1.0 else 0.0 end) as share from good group by all) s left join water w using (cell)""",
    "good", "water",
)
def b8_water_reject(spark, sf):
    return series.water_reject(X.series(spark, sf), X.water(spark, sf), share=0.01).withColumn("negative_share", F.round("negative_share", 6))


@_query("select site_id, cell, year, cast(obs_date - win_start + 1 as int) as day_idx, round(vi,6) as vi from good join years on obs_date between win_start and win_end", "good", "years")
def k5_year_windows(spark, sf):
    return series.year_windows(X.series(spark, sf).where("vi is not null"), PARAMS.years).select(*BY, "day_idx", *_r6("vi"))


@_query("select site_id, cell, year, count_if(obs_date - win_start + 1 between 186 and 550) as num_obs from good join years on obs_date between win_start and win_end group by all", "good", "years")
def d6_num_obs(spark, sf):
    return series.num_obs(series.year_windows(X.series(spark, sf).where("vi is not null"), PARAMS.years))


@_query("select site_id, cell, year, 735::bigint as n_slots, count(*) as n_seen from good join years on obs_date between win_start and win_end group by all", "good", "years")
def c4_daily_spine(spark, sf):
    windowed = series.year_windows(X.series(spark, sf).where("vi is not null"), PARAMS.years)
    return series.attach_daily_spine(windowed, PARAMS.years).groupBy(*BY).agg(F.count("*").alias("n_slots"), F.count("vi").alias("n_seen"))


@_query("select site_id, cell, slot_date, vi from curve", "curve")
def h16_interpolated_curve(spark, sf):
    return X.curve(spark, sf)


@_query(
    """, s as (select site_id, cell, year, day_idx, case when lead(v) over w > v then 1 when lead(v) over w < v then 2 else 0 end as code, lead(day_idx) over w as nxt
 from slots window w as (partition by site_id, cell, year order by day_idx)),
 n as (select *, case when code = lag(code) over w then 0 else 1 end as new from s where nxt is not null window w as (partition by site_id, cell, year order by day_idx)),
 r as (select *, sum(new) over (partition by site_id, cell, year order by day_idx) as run from n),
 g as (select site_id, cell, year, run, code, count(*) as n from r group by all)
 select site_id, cell, year, code, count(*) as runs, max(n) as longest from g group by all""",
    "slots",
)
def e5_run_length(spark, sf):
    runs = series.run_length(X.curve_slots(spark, sf), "v", BY, "day_idx")
    return runs.groupBy(*BY, "code").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


# despiking, curves, cycles


@_query(
    """, t as (select *, lag(obs_date) over w as d1, lead(obs_date) over w as d3, lag(blue) over w as b1, lead(blue) over w as b3, lag(red) over w as r1, lead(red) over w as r3,
  lag(vi) over w as e1, lead(vi) over w as e3 from good window w as (partition by site_id, cell order by obs_date)),
 u as (select *, case when d1 is not null and d3 is not null then (vi-e1)-(e3-vi) end as dd from t),
 m as (select *, median(dd) over (partition by site_id, cell) as md from u),
 a as (select *, median(case when d1 is not null and d3 is not null then abs(vi-md) end) over (partition by site_id, cell) as mad from m),
 f as (select *, coalesce(blue-b1 > 0.03*(1+(obs_date-d1)/30) and red-r1 < 1.5*(blue-b1) and blue-b3 > 0.03*(1+(d3-obs_date)/30) and red-r3 < 1.5*(blue-b3), false) as cloud,
  coalesce(e1+(e3-e1)*((obs_date-d1)::double/(d3-d1)::double)-vi > 0.1 and abs(e1+(e3-e1)*((obs_date-d1)::double/(d3-d1)::double)-vi) > 2*abs(e3-e1) and d3-d1 < 45, false) as dip,
  coalesce(dd < md-2*mad/0.6745 or dd > md+2*mad/0.6745, false) as jump from a)
 select site_id, cell, count(*) as n, count_if(cloud) as n_cloud, count_if(dip) as n_dip, count_if(jump) as n_jump, count_if(cloud or dip or jump) as n_spike from f group by all""",
    "good",
)
def k1_despike_pass(spark, sf):
    n = lambda c: F.count_if(c).alias(f"n_{c}")
    return despike.despike_pass(X.series(spark, sf)).groupBy(*CELL).agg(F.count("*").alias("n"), *map(n, ("cloud", "dip", "jump", "spike")))


@_query()
def k2_despike(spark, sf):
    return despike.despike(X.series(spark, sf), PARAMS).select(*CELL, "obs_date", *_r6("vi"))


def _clean(spark, sf):
    clean = series.floor_dormant(despike.despike(X.series(spark, sf), PARAMS), PARAMS.dormant_from, PARAMS.dormant_to)
    return clean, series.year_windows(clean.where("vi is not null"), PARAMS.years)


def _digest(curves: DataFrame) -> DataFrame:
    c = F.col("curve")
    total = F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return curves.select(*BY, F.round(F.array_min(c), 6).alias("lo"), F.round(F.array_max(c), 6).alias("hi"), F.round(total, 4).alias("area"))


@_query()
def k7_smooth_spline(spark, sf):
    _, windowed = _clean(spark, sf)
    return _digest(spline.smooth(spline.gathered(windowed, BY), BY, PARAMS.slots, PARAMS.spar))


@_query(
    """, t as (select *, avg(v) over (partition by site_id, cell, year) as m from slots where day_idx between 186 and 550),
 p as (select t.site_id, t.cell, t.year, o.year as other, count(*) as n, sqrt(sum((o.v-t.v)*(o.v-t.v))) as far, sqrt(sum((t.m-t.v)*(t.m-t.v))) as flat
  from t join t o on t.site_id = o.site_id and t.cell = o.cell and t.day_idx = o.day_idx group by all)
 select site_id, cell, year, other, n, round(case when n < 90 or flat = 0 then 0.0 else 0.5*greatest(0.0, 1-far/flat) end,6) as weight from p""",
    "slots",
)
def k8_year_weights(spark, sf):
    inside = X.curve_slots(spark, sf).where("day_idx between 186 and 550")
    return similarity.year_weights(inside, PARAMS).withColumn("weight", F.round("weight", 6))


@_query()
def k9_gap_fill_refit(spark, sf):
    clean, windowed = _clean(spark, sf)
    weights = similarity.year_weights(X.curve_slots(spark, sf).where("day_idx between 186 and 550"), PARAMS)
    points = similarity.refit_points(windowed, series.gap_islands(clean), weights, PARAMS)
    return _digest(similarity.gap_fill_refit(points, PARAMS))


@_query(
    """, s as (select *, case when lead(v) over w > v then 1 when lead(v) over w < v then 2 else 0 end as code from slots window w as (partition by site_id, cell, year order by day_idx)),
 t as (select *, lead(code) over w as nc, lead(day_idx) over w as nd from s where code <> 0 window w as (partition by site_id, cell, year order by day_idx)),
 p as (select site_id, cell, year, day_idx + 1 + cast(round_even((nd-day_idx-1)/2, 0) as bigint) as peak from t where code = 1 and nc = 2),
 whole as (select site_id, cell, year, min(day_idx) as d0, list(v order by day_idx) as vs from slots group by all)
 select p.site_id, p.cell, p.year, p.peak, vs[p.peak - d0 + 1] as v from p join whole using (site_id, cell, year)""",
    "slots",
)
def k10_find_peaks(spark, sf):
    return cycles.find_peaks(X.curve_slots(spark, sf), BY).withColumn("peak", F.col("peak").cast("long"))


def _arrays(spark, sf):
    """The daily curve of each window as an array; only windows that it fills."""
    rows = X.curve_slots(spark, sf).groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("day_idx", "v"))).alias("c"))
    return rows.where(F.size("c") == PARAMS.slots).select(*BY, F.col("c.v").alias("curve"))


@_query()
def k11_find_segments(spark, sf):
    found = cycles.find_segments(_arrays(spark, sf), BY, PARAMS)
    return found.select(*BY, F.posexplode("segs").alias("pos", "s")).select(*BY, "pos", "s.*")


_SEGS = """, full_years as (select site_id, cell, year from slots group by all having count(*) = 735),
 c as (select slots.* from slots join full_years using (site_id, cell, year)),
 pk as (select site_id, cell, year, arg_max(day_idx, v*1000000000 - day_idx) as p from c where day_idx between 186 and 550 group by all),
 st as (select c.site_id, c.cell, c.year, arg_min(c.day_idx, c.v*1000000000 - c.day_idx) as s from c join pk using (site_id, cell, year) where c.day_idx between p-185 and p group by all),
 en as (select c.site_id, c.cell, c.year, arg_min(c.day_idx, c.v*1000000000 + c.day_idx) as e from c join pk using (site_id, cell, year) where c.day_idx between p and p+185 group by all),
 segs as (select * from pk join st using (site_id, cell, year) join en using (site_id, cell, year)),
 lev as (select g.*, a.v as vs, b.v as vp, d.v as ve from segs g
  join c a on a.site_id=g.site_id and a.cell=g.cell and a.year=g.year and a.day_idx=g.s
  join c b on b.site_id=g.site_id and b.cell=g.cell and b.year=g.year and b.day_idx=g.p
  join c d on d.site_id=g.site_id and d.cell=g.cell and d.year=g.year and d.day_idx=g.e)"""


def _simple_segments(spark, sf):
    """The year's highest slot with the nearest lowest slots around it: cycles that SQL can name too."""
    rows = _arrays(spark, sf)
    pos = F.transform(F.col("curve"), lambda v, i: F.struct(v.alias("v"), (i + 1).alias("d")))
    rows = rows.withColumn("t", pos)
    peak = F.array_max(F.transform(F.slice("t", 186, 365), lambda x: F.struct(x["v"], (-x["d"]).alias("d"))))
    rows = rows.withColumn("seg_peak", -peak["d"])
    left = F.filter("t", lambda x: x["d"].between(F.col("seg_peak") - 185, F.col("seg_peak")))
    right = F.filter("t", lambda x: x["d"].between(F.col("seg_peak"), F.col("seg_peak") + 185))
    start = F.array_min(F.transform(left, lambda x: F.struct(x["v"], (-x["d"]).alias("d"))))
    end = F.array_min(F.transform(right, lambda x: F.struct(x["v"], x["d"].alias("d"))))
    return rows.select(*BY, "curve", "seg_peak", (-start["d"]).alias("seg_start"), end["d"].alias("seg_end"))


@_query(
    _SEGS
    + """ select l.site_id, l.cell, l.year, s as seg_start, p as seg_peak, e as seg_end,
 min(case when c.day_idx between s and p and round_even(c.v,6) >= round_even(vs+(vp-vs)*0.15,6) then c.day_idx end) as up1,
 min(case when c.day_idx between s and p and round_even(c.v,6) >= round_even(vs+(vp-vs)*0.5,6) then c.day_idx end) as up2,
 min(case when c.day_idx between s and p and round_even(c.v,6) >= round_even(vs+(vp-vs)*0.9,6) then c.day_idx end) as up3,
 max(case when c.day_idx between p and e and round_even(c.v,6) >= round_even(ve+(vp-ve)*0.9,6) then c.day_idx end) as down1,
 max(case when c.day_idx between p and e and round_even(c.v,6) >= round_even(ve+(vp-ve)*0.5,6) then c.day_idx end) as down2,
 max(case when c.day_idx between p and e and round_even(c.v,6) >= round_even(ve+(vp-ve)*0.15,6) then c.day_idx end) as down3
 from lev l join c on c.site_id=l.site_id and c.cell=l.cell and c.year=l.year group by all""",
    "slots",
)
def k12_pheno_dates(spark, sf):
    names = ["seg_start", "seg_peak", "seg_end", "up1", "up2", "up3", "down1", "down2", "down3"]
    return cycles.pheno_dates(_simple_segments(spark, sf)).select(*BY, *(F.col(c).cast("long").alias(c) for c in names))


@_query(
    _SEGS
    + """, o as (select site_id, cell, year, obs_date - win_start + 1 as d, vi from good join years on obs_date between win_start and win_end),
 j as (select l.site_id, l.cell, l.year, s, p, e, o.d, o.vi, c.v from lev l join o using (site_id, cell, year) join c on c.site_id=l.site_id and c.cell=l.cell and c.year=l.year and c.day_idx=o.d),
 g as (select site_id, cell, year, s, p, e, count_if(d between s and p) as up_n, count_if(d between p and e) as down_n,
  sum(case when d between s and p then (vi-v)*(vi-v) end) as sse, var_pop(vi) filter (where d between s and p) * count_if(d between s and p) as sst,
  sum(case when d between p and e then (vi-v)*(vi-v) end) as sse2, var_pop(vi) filter (where d between p and e) * count_if(d between p and e) as sst2 from j group by all),
 h as (select l.site_id, l.cell, l.year, max(c.v)-min(c.v) as amp, sum(c.v) as area from lev l join c on c.site_id=l.site_id and c.cell=l.cell and c.year=l.year and c.day_idx between s and e group by all),
 b as (select site_id, cell, year, d from j where d between s and p union all select site_id, cell, year, s from lev union all select site_id, cell, year, p from lev),
 x as (select site_id, cell, year, max(dd) as up_gap from (select site_id, cell, year, d - lag(d) over (partition by site_id, cell, year order by d) as dd from b) group by all),
 b2 as (select site_id, cell, year, d from j where d between p and e union all select site_id, cell, year, p from lev union all select site_id, cell, year, e from lev),
 x2 as (select site_id, cell, year, max(dd) as down_gap from (select site_id, cell, year, d - lag(d) over (partition by site_id, cell, year order by d) as dd from b2) group by all)
 select site_id, cell, year, up_n, down_n, round(1-sse/nullif(sst,0),4) as up_r2, round(amp,6) as amp, round(area,6) as area, up_gap, round(1-sse2/nullif(sst2,0),4) as down_r2, down_gap
 from g join h using (site_id, cell, year) join x using (site_id, cell, year) join x2 using (site_id, cell, year) where up_n > 0 and down_n > 0""",
    "slots", "good",
)
def k13_segment_metrics(spark, sf):
    windowed = series.year_windows(X.series(spark, sf).where("vi is not null"), PARAMS.years)
    seen = windowed.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct("day_idx", "vi"))).alias("o"))
    seen = seen.select(*BY, F.col("o.day_idx").alias("days"), F.col("o.vi").alias("values"))
    out = cycles.segment_metrics(_simple_segments(spark, sf).join(seen, BY)).where("up_n is not null")
    return out.select(
        *BY, F.col("up_n").cast("long").alias("up_n"), F.col("down_n").cast("long").alias("down_n"), F.round("up_r2", 4).alias("up_r2"),
        F.round("amp", 6).alias("amp"), F.round("area", 6).alias("area"), F.col("up_gap").cast("long").alias("up_gap"),
        F.round("down_r2", 4).alias("down_r2"), F.col("down_gap").cast("long").alias("down_gap"),
    )


@_query(
    """select site_id, cell, cast(year(slot_date) as int) as year, round(max(vi)*10000,4) as EVImax, round((max(vi)-min(vi))*10000,4) as EVIamp, round(sum(vi)*100,4) as EVIarea
 from curve group by all""",
    "curve",
)
def d7_annual_metrics(spark, sf):
    out = cycles.annual_metrics(X.curve(spark, sf), value="vi")
    return out.select(*BY, *(F.round(c, 4).alias(c) for c in ("EVImax", "EVIamp", "EVIarea")))


@_query(
    """, a as (select site_id, cell, cast(year(slot_date) as int) as year, round(max(vi)*10000,4) as EVImax, round((max(vi)-min(vi))*10000,4) as EVIamp, round(sum(vi)*100,4) as EVIarea from curve group by all),
 l as (unpivot a on EVImax, EVIamp, EVIarea into name short_name value val),
 k as (select *, cast(trunc(case when val between 0 and case when short_name = 'EVIarea' then 32766 else 10000 end then val else 32767 end) as smallint) as packed from l)
 select site_id, cell, year, short_name, packed, round(case when packed <> 32767 then packed * case when short_name = 'EVIarea' then 0.01::double else 0.0001::double end end,6) as unpacked from k""",
    "curve",
)
def b12_pack_unpack(spark, sf):
    long = product.to_long(d7_annual_metrics(spark, sf), BY, ["EVImax", "EVIamp", "EVIarea"])
    return product.unpack(product.pack(long)).select(*BY, "short_name", "packed", F.round("unpacked", 6).alias("unpacked"))


@_query(
    """, a as (select site_id, cell, cast(year(slot_date) as int) as year, max(vi) as hi, max(vi)-min(vi) as amp from curve group by all)
 select site_id, cell, year, not (hi between 0 and 1 and amp between 0 and 1) or (0.02 < 0.05 and amp < 0.3 and w.occ > 80) or (amp < 0.2 and w.occ > 30) as weak
 from a join water w using (cell)""",
    "curve", "water",
)
def b9_weak_cycle(spark, sf):
    a = X.curve(spark, sf).groupBy(*CELL, F.year("slot_date").alias("year")).agg(F.max("vi").alias("hi"), (F.max("vi") - F.min("vi")).alias("amp"))
    rows = a.join(X.water(spark, sf), "cell").withColumn("dormant", F.lit(0.02))
    return rows.select(*BY, cycles.weak_cycle("dormant", "hi", "amp", "occ").alias("weak"))


@_query(
    """, p as (select site_id, cell, cast(year(obs_date) as int) as year, cast(month(obs_date) as int) as m, max(vi)-min(vi) as amp from good group by all),
 r as (select *, row_number() over (partition by site_id, cell, year order by amp desc, m) as rank from p)
 select site_id, cell, year, count(*) as n_cycles, round(max(case when rank=1 then amp end),6) as amp_1, round(max(case when rank=2 then amp end),6) as amp_2 from r group by all""",
    "good",
)
def f3_top2_cycles(spark, sf):
    s = X.series(spark, sf).where("vi is not null")
    p = s.groupBy(*CELL, F.year("obs_date").alias("year"), F.month("obs_date").alias("m")).agg((F.max("vi") - F.min("vi")).alias("amp"))
    out = cycles.top2_cycles(cycles.rank_cycles(p, BY, "amp", "m"), BY, ["amp"])
    return out.select(*BY, "n_cycles", *_r6("amp_1", "amp_2"))


@_query()
def k16_phenology(spark, sf):
    out = P.phenology(X.series(spark, sf), X.water(spark, sf), PARAMS)
    return out.select(*BY, *(F.round(f"`{c}`", 3).alias(c) for c in product.LAYER_NAMES))


@_query()
def k17_explain_site(spark, sf):
    out = P.explain_pixel(X.series(spark, sf), X.water(spark, sf), F.col("site_id") == 2, PARAMS)
    return out.select(*BY, F.round("EVImax", 3).alias("EVImax"), "NumCycles", F.size("curve").alias("n_slots"), F.size("days").alias("n_days"))


@_query(
    "select l_orderkey, l_linenumber, case when gap <= 20 and r2 >= 0.75 then 1 when gap <= 20 or r2 >= 0.75 then 2 else 3 end as qa from"
    " (select l_orderkey, l_linenumber, greatest(l_quantity, l_linenumber*4) as gap, least(1-l_discount*5, 1-l_tax*4) as r2 from lineitem)"
)
def k14_qa_class(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (1 - F.col("l_discount") * 5).alias("a"), (1 - F.col("l_tax") * 4).alias("b"),
        F.col("l_quantity").cast("double").alias("c"), (F.col("l_linenumber") * 4).cast("double").alias("d"),
    )
    return rows.select("l_orderkey", "l_linenumber", cycles.qa_class("a", "b", "c", "d").alias("qa"))


# match-ups


@_query(
    """select p.c_custkey as station, count(*) as n_cells, cast(round_even(median(g.cell),0) as double) as median_value from
 (select c_custkey, 500001.5 + 3*((c_custkey%(select count(*) from supplier))%10) + 1.2 as px, 4000001.5 - 3*((c_custkey%(select count(*) from supplier))//10) - 1.2 as py from customer) p
 join grid g on (p.px-g.x)*(p.px-g.x)+(p.py-g.y)*(p.py-g.y) <= 7.5*7.5 group by p.c_custkey""",
    "grid",
)
def c11_buffer_extract(spark, sf):
    cells = X.grid(spark, sf).select("cell", F.col("x").alias("cx"), F.col("y").alias("cy"))
    out = matchup.buffer_extract(X.stations(spark, sf), cells, 7.5, "cell", [], ["station"])
    return out.select("station", "n_cells", F.col("median_value").cast("double").alias("median_value"))


_SHAPES = """, shapes(kind, ring, i, px, py) as (values (0,0,0,0,0),(0,0,1,6,0),(0,0,2,3,3),(0,0,3,6,6),(0,0,4,0,6),(0,0,5,0,0),(1,0,0,0,0),(1,0,1,5,0),(1,0,2,5,5),(1,0,3,0,5),(1,0,4,0,0),
  (1,1,0,1,1),(1,1,1,1,4),(1,1,2,4,4),(1,1,3,4,1),(1,1,4,1,1),(1,2,0,7,0),(1,2,1,9,0),(1,2,2,9,3),(1,2,3,7,0)),
 borders as (select a.kind, a.ring, a.i, a.px as ax, a.py as ay, b.px as qx, b.py as qy from shapes a join shapes b on a.kind = b.kind and a.ring = b.ring and b.i = a.i + 1),
 areas as (select s_suppkey as site, s_suppkey * 53 % 1009 as ox, s_suppkey * 71 % 1013 as oy, case when s_suppkey % 25 = 0 then 150 else s_suppkey % 7 + 1 end as size, 1 - s_suppkey % 2 as kind from supplier),
 site_edges as (select site, ring, i, ox + ax*size as ax, oy + ay*size as ay, ox + qx*size as qx, oy + qy*size as qy from areas join borders using (kind))"""

#: Extents of 10 m to 1000 km, one around another.
_SCALES = [(k, 500000.0 - w, 500000.0 + w, 4000000.0 - w, 4000000.0 + w / 2) for k, w in enumerate((10.0, 100.0, 3000.0, 100000.0, 1000000.0))]


@_query(
    f"""select c_custkey as station, site from (select c_custkey, 500001.5 + 3*((c_custkey%(select count(*) from supplier))%10) + 1.2 as x, 4000001.5 - 3*((c_custkey%(select count(*) from supplier))//10) - 1.2 as y from customer)
 join (values {", ".join(map(str, _SCALES))}) e(site, x0, x1, y0, y1) on x between x0 and x1 and y between y0 and y1
 union all select c_custkey, 100 + s_suppkey from customer, (select s_suppkey, 500000.0 + 3*(s_suppkey%10) as w, 4000000.0 - 3*(s_suppkey//10) as n from supplier)
 where 500001.5 + 3*((c_custkey%(select count(*) from supplier))%10) + 1.2 between w and w + 3 + s_suppkey%4 and 4000001.5 - 3*((c_custkey%(select count(*) from supplier))//10) - 1.2 between n - s_suppkey%5 and n + 1"""
)
def c9_point_in_extent(spark, sf):
    """Stations in extents of cells, and in some of up to 1000 km that hold many or all of them."""
    wide = spark.createDataFrame(_SCALES, "site long, x0 double, x1 double, y0 double, y1 double")
    k = F.col("s_suppkey")
    w, n = 500000.0 + 3 * (k % 10), 4000000.0 - 3 * F.floor(k / 10)
    own = X.table(spark, sf, "supplier").select((k + 100).alias("site"), w.alias("x0"), (w + 3 + k % 4).alias("x1"), (n - k % 5).alias("y0"), (n + 1).alias("y1"))
    return matchup.point_in_extent(X.stations(spark, sf), wide.union(own)).select("station", "site")


@_query(
    _SHAPES
    + """, points as (select o_orderkey as point, o_orderkey * 13 % 1009 + 0.5 as x, o_orderkey * 29 % 1013 + 0.25 as y from orders)
 select point, min(lpad(site::varchar, 6, '0')) as tile from (
  select point, site from points join areas on x between ox and ox + 9*size and y between oy and oy + 6*size join site_edges using (site)
  group by point, site having count(*) filter ((ay > y) <> (qy > y) and x < ax + (y - ay) * (qx - ax) / (qy - ay)) % 2 = 1) group by point""",
    "years",
)
def c10_point_in_tile(spark, sf):
    """Points of orders in suppliers' polygons: notched, or with a hole and a second part."""
    o = F.col("o_orderkey")
    points = X.table(spark, sf, "orders").select(o.alias("point"), (o * 13 % 1009 + 0.5).alias("x"), (o * 29 % 1013 + 0.25).alias("y"))
    tiles = X.site_polygons(spark, sf).select(F.lpad(F.col("site").cast("string"), 6, "0").alias("name"), "rings")
    return matchup.point_in_tile(points, tiles, "point")


def _event_dates(spark, sf):
    left = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y"))
    left = left.agg(F.min("l_shipdate").cast("date").alias("d"))
    right = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("e"))
    return left, right


_NEAR = """, l as (select l_suppkey as k, cast(year(l_shipdate) as int) as y, cast(min(l_shipdate) as date) as d from lineitem group by 1, 2),
 r as (select o_custkey as k, cast(o_orderdate as date) as e from orders),
 m as (select l.k, l.y, l.d, r.e as nearest, abs(l.d - r.e) as days_apart, row_number() over (partition by l.k, l.y, l.d order by abs(l.d-r.e), r.e) as n from l join r on l.k = r.k and abs(l.d-r.e) < 100)"""


@_query(_NEAR + " select k, y, d, nearest, cast(days_apart as int) as days_apart from m where n = 1", "years")
def c12_nearest_within(spark, sf):
    return matchup.nearest_within(*_event_dates(spark, sf), ["k"], "d", "e")


@_query(
    _NEAR
    + """ select y, count(*) as n, round(corr(a::double, b::double),6) as r, round(sqrt(avg((a-b)*(a-b))),6) as rmse, round(avg(a-b),6) as bias from
 (select y, dayofyear(d) as a, dayofyear(nearest) + case when year(nearest) < y then -365 when year(nearest) > y then 365 else 0 end as b from m where n = 1) group by y""",
    "years",
)
def h7_days_across_years(spark, sf):
    near = c12_nearest_within(spark, sf)
    pairs = near.select("y", F.dayofyear("d").alias("a"), S.doy_across_years("nearest", "y").alias("b"))
    return matchup.agreement(pairs, "a", "b", ["y"]).select("y", "n", *_r6("r", "rmse", "bias"))


@_query(
    "select cast(least(floor((l_quantity-0)*20/50.0),19) as bigint) as bx, cast(least(floor((l_extendedprice-0)*20/110000.0),19) as bigint) as \"by\", count(*) as n"
    " from lineitem where l_quantity between 0 and 50 and l_extendedprice between 0 and 110000 group by 1, 2"
)
def d14_density_2d(spark, sf):
    return matchup.density_2d(X.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 0.0, 50.0, 0.0, 110000.0, 20)


_SITES = """, cells as (select n.n_regionkey as site, s.s_suppkey as cell, g.row, g.col, g.x as cx, g.y as cy from supplier s join nation n on s.s_nationkey = n.n_nationkey join grid g on g.cell = s.s_suppkey),
 extents as (select site, min(cx) - 1.5 as x0, max(cx) + 1.5 as x1, min(cy) - 1.5 as y0, max(cy) + 1.5 as y1 from cells group by site),
 drawn as (select site, point, x0 + cast(('0x' || substring(md5(site || '|' || point || '|11'), 1, 7)) as bigint) / 268435456.0::double * (x1 - x0) as x,
  y0 + cast(('0x' || substring(md5(site || '|' || point || '|12'), 1, 7)) as bigint) / 268435456.0::double * (y1 - y0) as y from extents, lateral (select unnest(range(3000)) as point))"""


@_query(_SITES + " select site, point, round(x, 6) as x, round(y, 6) as y from drawn", "grid")
def f5_random_points(spark, sf):
    return matchup.random_points(X.site_extents(spark, sf), 3000, 11).select("site", F.col("point").cast("long").alias("point"), *_r6("x", "y"))


@_query(
    _SITES
    + """, yearly as (select site_id as site, cell, year(obs_date) as year, round(max(vi)*10000, 0) as hi, round(min(vi)*10000, 0) as lo from good group by all),
 layers as (select site, cell, year || 'EVImax' as layer, hi as value from yearly union all select site, cell, year || 'EVIamp', hi - lo from yearly),
 fine as (select l.site, c.cx, c.cy, l.layer, l.value from layers l join cells c on c.cell = l.cell),
 tile as (select site, min(name) as tile from drawn join (select min(x) as west, max(x) as east from grid) on true
  join (values ('T0', 0), ('T1', 1)) t(name, k) on x between west - 2 + k * 9 and east + 2 - (1 - k) * 9 group by site),
 coarse as (select name as tile, avg(cx) as cx, avg(cy) as cy, layer, round(avg(value), 0) as value from layers join cells using (cell), (values ('T0'), ('T1')) t(name)
  group by name, row // 2, col // 2, layer),
 a as (select d.site, d.point, layer, round_even(median(value), 0) as ma, round_even(avg(value), 0) as aa from drawn d join fine f on f.site = d.site
  and (d.x-f.cx)*(d.x-f.cx)+(d.y-f.cy)*(d.y-f.cy) <= 4.5*4.5 group by all),
 b as (select d.site, d.point, layer, round_even(median(value), 0) as mb, round_even(avg(value), 0) as ab from drawn d join tile using (site) join coarse f on f.tile = tile.tile
  and (d.x-f.cx)*(d.x-f.cx)+(d.y-f.cy)*(d.y-f.cy) <= 4.5*4.5 group by all),
 p as (select *, row_number() over (partition by layer order by md5(site || '|' || point || '|11'), site, point) as r from a join b using (site, point, layer)),
 st as (select layer, 'median' as stat, ma as a, mb as b from p where r <= 100000 union all select layer, 'mean', aa, ab from p where r <= 100000)
 select layer, stat, count(*) as n, round(corr(a, b), 6) as r, round(sqrt(avg((a-b)*(a-b))), 6) as rmse, round(avg(a-b), 6) as bias from st group by all""",
    "grid", "good",
)
def k21_grid_matchup(spark, sf):
    """A product of cells and one of blocks of four, in two tiles that overlap, around 3000 points of each site."""
    layers = X.yearly_layers(spark, sf).withColumn("layer", F.concat(F.col("year").cast("string"), "layer")).drop("year")
    cells = X.site_cells(spark, sf)
    fine = layers.join(cells.select("cell", "cx", "cy"), "cell").select("site", "cx", "cy", "layer", "value")
    name = F.explode(F.array(F.lit("T0"), F.lit("T1"))).alias("tile")
    blocks = layers.drop("site").join(cells, "cell").select(name, F.floor(F.col("row") / 2).alias("br"), F.floor(F.col("col") / 2).alias("bc"), "cx", "cy", "layer", "value")
    coarse = blocks.groupBy("tile", "br", "bc", "layer").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"), F.round(F.avg("value")).alias("value"))
    e = X.grid(spark, sf).agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    both = e.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "*").select(
        F.concat(F.lit("T"), F.col("k").cast("string")).alias("name"), (F.col("w") - 2 + F.col("k") * 9).alias("x0"), (F.col("e") + 2 - (1 - F.col("k")) * 9).alias("x1"),
        (F.col("s") - 2).alias("y0"), (F.col("n") + 2).alias("y1"),
    )
    corner = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    ring = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"), corner("x0", "y0"))
    tiles = both.withColumn("rings", F.array(ring))
    out = matchup.grid_matchup(X.site_extents(spark, sf), tiles, fine, coarse, radius=4.5)
    return out.select("layer", "stat", "n", *_r6("r", "rmse", "bias"))


@_query("select o_orderkey, o_custkey from orders order by md5(o_orderkey || '|456123'), o_orderkey limit 50")
def f4_sample_n(spark, sf):
    return matchup.sample_n(X.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 50, "o_orderkey", 456123)


@_query(
    "select coalesce(a.d, b.d) as d, round(a.v,6) as v, b.n from (select obs_date as d, avg(vi) as v from good group by 1) a full join (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1) b on a.d = b.d",
    "good",
)
def c16_series_overlay(spark, sf):
    a = X.series(spark, sf).where("vi is not null").groupBy(F.col("obs_date").alias("d")).agg(F.round(F.avg("vi"), 6).alias("v"))
    b = X.table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    return matchup.series_overlay(a, b, ["d"])


@_query(
    """, cells as (select n.n_regionkey as site, s.s_suppkey as cell, g.x as cx, g.y as cy from supplier s join nation n on s.s_nationkey = n.n_nationkey join grid g on g.cell = s.s_suppkey),
 extents as (select site, min(cx) - 1.5 as x0, max(cx) + 1.5 as x1, min(cy) - 1.5 - 30 as y0, max(cy) + 1.5 - 30 as y1 from cells group by site),
 st as (select c_custkey as station, c_mktsegment as veg, 500001.5 + 3*((c_custkey%(select count(*) from supplier))%10) + 1.2 as x, 4000001.5 - 3*((c_custkey%(select count(*) from supplier))//10) - 1.2 - 30 as y from customer),
 inside as (select station, veg, site, x, y + 30.0 as y from st join extents on x between x0 and x1 and y between y0 and y1),
 turns as (select site_id as site, cell, cast(year(obs_date) as int) as year, dayofyear(min(obs_date)) as a, dayofyear(max(obs_date)) as b from good group by all),
 doys as (select site, cell, year, 'rising' as direction, a as value from turns union all select site, cell, year, 'falling', b from turns),
 around as (select i.station, i.veg, i.site, d.year, d.direction, round_even(median(d.value), 0) as m from inside i join cells c on c.site = i.site
  and (i.x-c.cx)*(i.x-c.cx)+(i.y-c.cy)*(i.y-c.cy) <= 7.5*7.5 join doys d on d.cell = c.cell and d.site = c.site group by all),
 told as (select *, cast(make_date(year - 1, 12, 31) + cast(m as int) as date) as told from around),
 seen as (select distinct o_custkey as station, case when o_orderkey % 2 = 0 then 'rising' else 'falling' end as direction, cast(o_orderdate as date) as seen from orders),
 near as (select t.*, s.seen, row_number() over (partition by t.station, t.site, t.year, t.direction order by abs(told - seen), seen) as r
  from told t join seen s on s.station = t.station and s.direction = t.direction and abs(told - seen) < 100),
 p as (select veg, direction, dayofyear(seen) + case when year(seen) < year(told) then -365 when year(seen) > year(told) then 365 else 0 end as a, dayofyear(told) as b from near where r = 1)
 select veg, direction, count(*) as n, round(corr(a::double, b::double), 6) as r, round(sqrt(avg((a-b)*(a-b))), 6) as rmse, round(avg(a-b), 6) as bias from p group by all""",
    "grid", "good",
)
def k20_station_matchup(spark, sf):
    """Stations 30 m south of the cells; first and last clear days of a cell's year stand for its transitions."""
    low = [(F.col(c) - 30).alias(c) for c in ("y0", "y1")]
    extents = X.site_extents(spark, sf).select("site", "x0", "x1", *low)
    veg = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("station"), F.col("c_mktsegment").alias("veg"))
    stations = X.stations(spark, sf).withColumn("y", F.col("y") - 30).join(veg, "station")
    turns = X.series(spark, sf).where("vi is not null").groupBy(F.col("site_id").alias("site"), "cell", F.year("obs_date").alias("year")).agg(
        F.dayofyear(F.min("obs_date")).alias("a"), F.dayofyear(F.max("obs_date")).alias("b")
    )
    cells = turns.select("site", "cell", "year", F.expr("stack(2, 'rising', a, 'falling', b) as (direction, value)")).join(X.site_cells(spark, sf).select("cell", "cx", "cy"), "cell")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "rising").otherwise("falling").alias("direction")
    dates = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("station"), kind, F.col("o_orderdate").cast("date").alias("seen"))
    return matchup.station_matchup(stations, extents, cells.drop("cell"), dates, ["veg"]).select("veg", "direction", "n", *_r6("r", "rmse", "bias"))


# catalogs


@_query("select item_id, acquired, cloud_cover from items where acquired >= date '1996-01-01' and acquired < date '1999-01-01' and cloud_cover between 0 and 0.5 and quality_category = 'standard' and ground_control", "items")
def b6_scene_filter(spark, sf):
    return catalog.scene_filter(X.items(spark, sf), "1996-01-01", "1999-01-01").select("item_id", "acquired", "cloud_cover")


_MEET = """, foot as (select item_id, item_id * 37 % 1009 as ox, item_id * 91 % 1013 as oy, item_id % 5 + 1 as size, case when item_id % 3 = 0 then 1 else 0 end as kind from items
  where acquired >= date '1996-01-01' and acquired < date '1999-01-01' and cloud_cover between 0 and 0.5 and quality_category = 'standard' and ground_control),
 foot_edges as (select item_id, ring, i, ox + ax*size as ax, oy + ay*size as ay, ox + qx*size as qx, oy + qy*size as qy from foot join borders using (kind)),
 near as (select f.item_id, a.site from foot f join areas a on f.ox <= a.ox + 9*a.size and a.ox <= f.ox + 9*f.size and f.oy <= a.oy + 6*a.size and a.oy <= f.oy + 6*f.size),
 turns as (select item_id, site, e.ax as eax, e.ay as eay, e.qx as ebx, e.qy as eby, f.ax as fax, f.ay as fay, f.qx as fbx, f.qy as fby,
  sign((f.qx-f.ax)*(e.ay-f.ay) - (f.qy-f.ay)*(e.ax-f.ax)) as t1, sign((f.qx-f.ax)*(e.qy-f.ay) - (f.qy-f.ay)*(e.qx-f.ax)) as t2,
  sign((e.qx-e.ax)*(f.ay-e.ay) - (e.qy-e.ay)*(f.ax-e.ax)) as t3, sign((e.qx-e.ax)*(f.qy-e.ay) - (e.qy-e.ay)*(f.qx-e.ax)) as t4
  from near join foot_edges e using (item_id) join site_edges f using (site)),
 touch as (select distinct item_id, site from turns where (t1*t2 < 0 and t3*t4 < 0)
  or (t1 = 0 and eax between least(fax,fbx) and greatest(fax,fbx) and eay between least(fay,fby) and greatest(fay,fby))
  or (t2 = 0 and ebx between least(fax,fbx) and greatest(fax,fbx) and eby between least(fay,fby) and greatest(fay,fby))
  or (t3 = 0 and fax between least(eax,ebx) and greatest(eax,ebx) and fay between least(eay,eby) and greatest(eay,eby))
  or (t4 = 0 and fbx between least(eax,ebx) and greatest(eax,ebx) and fby between least(eay,eby) and greatest(eay,eby))),
 a_in_b as (select item_id, site from near join foot_edges p using (item_id) join site_edges e using (site) where p.i = 0
  group by item_id, site, p.ring having count(*) filter ((e.ay > p.ay) <> (e.qy > p.ay) and p.ax < e.ax + (p.ay - e.ay) * (e.qx - e.ax)::double / (e.qy - e.ay)) % 2 = 1),
 b_in_a as (select item_id, site from near join site_edges p using (site) join foot_edges e using (item_id) where p.i = 0
  group by item_id, site, p.ring having count(*) filter ((e.ay > p.ay) <> (e.qy > p.ay) and p.ax < e.ax + (p.ay - e.ay) * (e.qx - e.ax)::double / (e.qy - e.ay)) % 2 = 1)"""


@_query(_SHAPES + _MEET + " select * from touch union select * from a_in_b union select * from b_in_a", "items")
def b6_scenes_of_sites(spark, sf):
    """Footprints against all sites' polygons: crossing, touching, nested, within holes."""
    scenes = catalog.scene_filter(X.footprints(spark, sf), "1996-01-01", "1999-01-01")
    return catalog.scenes_of_sites(scenes, X.site_polygons(spark, sf)).select("item_id", "site")


@_query(
    _SHAPES
    + _MEET.replace("from foot f join areas a on", "from foot f join (select -1 as site, 300 as ox, 300 as oy, 40 as size, 1 as kind) a on")
    .replace("join site_edges", "join (select -1 as site, ring, i, 300 + ax*40 as ax, 300 + ay*40 as ay, 300 + qx*40 as qx, 300 + qy*40 as qy from borders where kind = 1)")
    + " select item_id from touch union select item_id from a_in_b union select item_id from b_in_a",
    "items",
)
def b6_scenes_by_polygon(spark, sf):
    """Footprints that share a point with one polygon of a hole and two parts."""
    area = [[(300.0 + 40 * x, 300.0 + 40 * y) for x, y in ring] for ring in X.RINGED]
    return catalog.scene_filter(X.footprints(spark, sf), "1996-01-01", "1999-01-01", geometry=area).select("item_id")


@_query("select cell_group, cast(date_trunc('year', acquired) as date) as period, count(*) as n from items group by all", "items")
def d9_scene_counts(spark, sf):
    return catalog.scene_counts(X.items(spark, sf), ["cell_group"])


@_query(
    """select item_id, cell_group, cast(floor((row_number() over (partition by cell_group order by item_id)-1)/4) as int) as batch,
 ceil(count(*) over (partition by cell_group)/4) > 79 as "over" from items""",
    "items",
)
def e8_id_batches(spark, sf):
    """Batches so small that some groups need more of them than may be ordered at once, and some don't."""
    return catalog.id_batches(X.items(spark, sf), "cell_group", size=4).select("item_id", "cell_group", "batch", "over")


_DONE = "select distinct o_custkey % 50 as cell_group from orders where o_orderstatus = 'F' and o_custkey % 50 < 30"


@_query(f"select cell_group, count(*) as n from items where cell_group not in ({_DONE}) group by all", "items")
def c14_skip_existing(spark, sf):
    return catalog.skip_existing(X.items(spark, sf), X.orders_done(spark, sf), "cell_group").groupBy("cell_group").agg(F.count("*").alias("n"))


@_query(f"select cell_group, count(*) as n from items where cell_group in ({_DONE}) group by all", "items")
def c14_match_orders(spark, sf):
    return catalog.match_orders(X.items(spark, sf), X.orders_done(spark, sf), "cell_group").groupBy("cell_group").agg(F.count("*").alias("n"))


@_query(
    "select o_orderpriority as order_name, count_if(o_orderstatus='F') as success, count_if(o_orderstatus='O') as failed, count_if(o_orderstatus='P') as skipped from orders group by rollup (o_orderpriority)"
)
def d13_download_summary(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return catalog.download_summary(X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("order_name"), state.alias("state")))


@_query(
    f"""select cell_group, cast(floor((r-1)/400) as int) as batch, any_value(ceil(n_all/400) > 79) as "over", count(*) as n, printf('%s_%02d_1996_1998', cast(cell_group as varchar), cast(floor((r-1)/400) as int)) as order_name,
 cell_group in ({_DONE}) as existing from (select *, row_number() over (partition by cell_group order by item_id) as r, count(*) over (partition by cell_group) as n_all from items where acquired >= date '1996-01-01' and acquired < date '1999-01-01'
 and cloud_cover between 0 and 0.5 and quality_category = 'standard' and ground_control) group by cell_group, cast(floor((r-1)/400) as int)""",
    "items",
)
def k22_scene_availability(spark, sf):
    return catalog.scene_availability(X.items(spark, sf), X.orders_done(spark, sf), "cell_group", "1996-01-01", "1999-01-01", (1996, 1998))


# scalar functions, sets


@_query(
    """select o_orderkey, cast(strptime(substring(p,5,8),'%Y%m%d') as date) as scene_date, substring(p,5,12) as scene_key, replace(replace(o_orderpriority,'&','and'),' ','_') as site, lpad(cast(o_custkey % 200 as varchar),3,'0') as chunk_no
 from (select *, 'img/' || strftime(cast(o_orderdate as date), '%Y%m%d') || '_' || lpad(cast(o_orderkey % 1000 as varchar),3,'0') as p from orders)"""
)
def h1_scene_names(spark, sf):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    rows = X.table(spark, sf, "orders").withColumn("p", F.concat(F.lit("img/"), day, F.lit("_"), S.zero_pad(F.col("o_orderkey") % 1000)))
    return rows.select(
        "o_orderkey", S.scene_date("p", 5, 8).alias("scene_date"), S.scene_key("p", 5, 16).alias("scene_key"), S.clean_site_name("o_orderpriority").alias("site"),
        S.zero_pad(F.col("o_custkey") % 200).alias("chunk_no"),
    )


@_query(
    """select o_orderkey, cast(d - make_date(year(d)-1,12,31) as int) as doy, cast(make_date(year(d)-1,12,31) + cast(o_custkey % 400 as int) as date) as from_doy,
 cast(dayofyear(d) + 365 as int) as across from (select *, cast(o_orderdate as date) as d from orders)"""
)
def h5_days_of_year(spark, sf):
    d = F.col("o_orderdate").cast("date")
    return X.table(spark, sf, "orders").select(
        "o_orderkey", S.doy_from_year(d, F.year(d)).alias("doy"), S.date_from_doy(F.year(d), F.col("o_custkey") % 400).alias("from_doy"),
        S.doy_across_years(d, F.year(d) - 1).alias("across"),
    )


@_query("select cell, cast(row*10+col+1 as bigint) as number, cast(least(floor((cell-1)/5),19)+1 as bigint) as chunk, x + 0.0 as x, y + 30.0 as y30, cast(floor((x-500000.0)/3) as bigint) as xi from grid", "grid")
def h15_grid_cells(spark, sf):
    g = X.grid(spark, sf)
    return g.select(
        "cell", S.cell_number("row", "col", 10).alias("number"), S.chunk_of("cell", 20, F.lit(100)).alias("chunk"), "x", S.shift_point("y").alias("y30"),
        S.xy_index("x", 500000.0, 3.0).alias("xi"),
    )


@_query(
    "select c_custkey, case c_mktsegment when 'AUTOMOBILE' then 1 when 'BUILDING' then 2 when 'FURNITURE' then 3 when 'HOUSEHOLD' then 4 when 'MACHINERY' then 11 end as code from customer"
)
def b18_veg_class_code(spark, sf):
    names = {"AUTOMOBILE": "CRO", "BUILDING": "DBF", "FURNITURE": "MF", "HOUSEHOLD": "ENF", "MACHINERY": "EBF"}
    veg = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("c_mktsegment"))
    return X.table(spark, sf, "customer").select("c_custkey", S.veg_class_code(veg).alias("code"))


@_query("select event_type, count(*) as n from events where event_type in ('click', 'view') and value is not null group by all")
def b15_direction_filter(spark, sf):
    rows = X.table(spark, sf, "events").withColumn("kind", F.when(F.col("value").isNotNull(), "gcc_90"))
    return masks.point_filter(rows, ("click", "view"), "kind", "gcc_90", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@_query("select g.cell, count(d.obs_date) as n_days from grid g left join (select * from daily where site_id <> 3) d using (cell) group by g.cell", "grid", "daily")
def g2_merge_chunks(spark, sf):
    parts = mosaic.daily_pipeline(X.obs(spark, sf)).where("site_id <> 3")
    return mosaic.merge_chunks(X.grid(spark, sf).select("cell"), parts, ["cell"]).groupBy("cell").agg(F.count("obs_date").alias("n_days"))
