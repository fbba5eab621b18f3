"""Queries of expressions and small operators that others are made of, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries as Q
from .functions import scalar as S
from .operators import cycles, masks, matchup, series
from .plans import fixtures as X
from .plans import phenology as P
from .plans.fixtures import PARAMS
from .queries import BY, CELL, _query, _r6
from .sources import tables as T


@_query("select site_id, cell, obs_date, round(red/10000, 6) as red, round(nir/10000, 6) as nir from daily", "daily")
def b1_to_reflectance(spark, sf):
    d = Q.mosaic.daily_pipeline(X.obs(spark, sf))
    return d.select(*CELL, "obs_date", F.round(S.to_reflectance("red"), 6).alias("red"), F.round(S.to_reflectance("nir"), 6).alias("nir"))


@_query("select site_id, cell, obs_date, round(case when vi < red then red else vi end, 6) as floored from vi", "vi")
def b7_floor_at(spark, sf):
    return X.series(spark, sf).select(*CELL, "obs_date", F.round(S.floor_at("vi", "red"), 6).alias("floored"))


@_query(
    """, m as (select site_id, cell, year, arg_max(day_idx, v*1000000000 - day_idx) as seg_peak, max(v) as v from slots group by all)
 select site_id, cell, year, seg_peak from m where seg_peak > 185 and seg_peak <= 550""",
    "slots",
)
def b11_peak_in_year(spark, sf):
    """Of each window's highest slots, those inside the calendar year."""
    top = X.curve_slots(spark, sf).groupBy(*BY).agg((-F.max(F.struct("v", (-F.col("day_idx")).alias("d")))["d"]).alias("seg_peak"))
    return cycles.peaks_in_year(top).withColumn("seg_peak", F.col("seg_peak").cast("long"))


@_query("select o_orderkey, o_totalprice from (select *, row_number() over (order by o_orderdate, o_orderkey, o_totalprice) as r from orders) where r between 101 and 250")
def b16_row_slice(spark, sf):
    rows = X.table(spark, sf, "orders")
    return masks.row_slice(rows, "o_orderdate", 101, 250, ["o_orderkey", "o_totalprice"])


@_query(
    """, l as (select site_id, cell, year, short_name, val from (select site_id, cell, cast(year(obs_date) as int) as year, round(max(vi)*10000, 0) as EVImax from good group by all)
  unpivot (val for short_name in (EVImax))),
 p as (select *, cast(trunc(case when val between 0 and 10000 then val else 32767 end) as smallint) as packed from l)
 select site_id, cell, year, case when packed <> 32767 then round(packed * 0.0001::double, 6) end as unpacked from p""",
    "good",
)
def b13_unpack_layer(spark, sf):
    a = X.series(spark, sf).where("vi is not null").groupBy(*CELL, F.year("obs_date").alias("year")).agg(F.round(F.max("vi") * 10000).alias("v"))
    packed = a.withColumn("packed", S.pack_layer("v", F.lit(0), F.lit(10000), F.lit(32767)))
    return packed.select(*BY, F.round(S.unpack_layer("packed", F.lit(0.0001), F.lit(0.0), F.lit(32767)), 6).alias("unpacked"))


@_query("select site_id, cell, round(avg(case when vi < 0.2 then 1.0 else 0.0 end), 6) as share from good group by all", "good")
def d4_negative_share(spark, sf):
    """Shifted by 0.2, so that some values are negative."""
    s = X.series(spark, sf).where("vi is not null").withColumn("vi", F.col("vi") - 0.2)
    out = series.water_reject(s, X.water(spark, sf))
    return out.select(*CELL, F.round("negative_share", 6).alias("share"))


@_query(
    """select site_id, year, count(*) as n, round(corr(hi, lo), 6) as r, round(sqrt(avg((hi-lo)*(hi-lo))), 6) as rmse, round(avg(hi-lo), 6) as bias from
 (select site_id, cell, cast(year(obs_date) as int) as year, max(vi) as hi, min(vi) as lo from good group by all) group by all""",
    "good",
)
def d10_agreement(spark, sf):
    a = X.series(spark, sf).where("vi is not null").groupBy(*CELL, F.year("obs_date").alias("year")).agg(F.max("vi").alias("hi"), F.min("vi").alias("lo"))
    return matchup.agreement(a, "hi", "lo", ["site_id", "year"]).select("site_id", "year", "n", *_r6("r", "rmse", "bias"))


@_query(
    """select p.c_custkey as station, count(*) as n_cells, round_even(avg(g.cell), 0) as mean_value, round_even(median(g.cell), 0) as median_value from
 (select c_custkey, 500001.5 + 3*((c_custkey%(select count(*) from supplier))%10) + 1.2 as px, 4000001.5 - 3*((c_custkey%(select count(*) from supplier))//10) - 1.2 as py from customer) p
 join grid g on (p.px-g.x)*(p.px-g.x)+(p.py-g.y)*(p.py-g.y) <= 4.5*4.5 group by p.c_custkey""",
    "grid",
)
def d12_buffer_stat(spark, sf):
    cells = X.grid(spark, sf).select("cell", F.col("x").alias("cx"), F.col("y").alias("cy"))
    out = matchup.buffer_extract(X.stations(spark, sf), cells, 4.5, "cell", [], ["station"])
    return out.select("station", "n_cells", F.col("mean_value").cast("double").alias("mean_value"), F.col("median_value").cast("double").alias("median_value"))


@_query("select cell, cast(row*10+col+1 as bigint) as number from grid", "grid")
def e9_cell_number(spark, sf):
    return X.grid(spark, sf).select("cell", S.cell_number("row", "col", 10).alias("number"))


@_query(
    """, p as (select site_id, cell, cast(year(obs_date) as int) as year, cast(month(obs_date) as int) as m, max(vi)-min(vi) as amp from good group by all)
 select site_id, cell, year, m, cast(row_number() over (partition by site_id, cell, year order by amp desc, m) as int) as rank from p""",
    "good",
)
def e10_rank_cycles(spark, sf):
    s = X.series(spark, sf).where("vi is not null")
    p = s.groupBy(*BY[:2], F.year("obs_date").alias("year"), F.month("obs_date").alias("m")).agg((F.max("vi") - F.min("vi")).alias("amp"))
    return cycles.rank_cycles(p, BY, "amp", "m").select(*BY, "m", "rank")


@_query("select o_custkey as station, list(distinct cast(o_orderdate as date) order by cast(o_orderdate as date))[1] as first_date, count(distinct cast(o_orderdate as date)) as n from orders group by 1")
def f1_sort_dates(spark, sf):
    dates = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("station")).agg(F.collect_set(F.col("o_orderdate").cast("date")).alias("d"))
    return dates.select("station", F.sort_array("d")[0].alias("first_date"), F.size("d").cast("long").alias("n"))


@_query(
    """, s as (select *, case when lead(v) over w > v then 1 when lead(v) over w < v then 2 else 0 end as code from slots window w as (partition by site_id, cell, year order by day_idx)),
 t as (select *, lead(code) over w as nc, lead(day_idx) over w as nd from s where code <> 0 window w as (partition by site_id, cell, year order by day_idx)),
 p as (select site_id, cell, year, day_idx + 1 + cast(round_even((nd-day_idx-1)/2, 0) as bigint) as peak from t where code = 1 and nc = 2),
 whole as (select site_id, cell, year, min(day_idx) as d0, list(v order by day_idx) as vs from slots group by all),
 q as (select site_id, cell, year, peak, vs[peak - d0 + 1] as v from p join whole using (site_id, cell, year))
 select site_id, cell, year, peak, row_number() over (partition by site_id, cell, year order by v, peak) as place from q""",
    "slots",
)
def f2_peaks_by_magnitude(spark, sf):
    return cycles.peaks_by_magnitude(cycles.find_peaks(X.curve_slots(spark, sf), BY), BY).select(*BY, F.col("peak").cast("long").alias("peak"), F.col("place").cast("long").alias("place"))


@_query("select 'order' as kind, o_orderkey as id, cast(o_orderdate as date) as d from orders union all select 'line', l_orderkey, cast(l_shipdate as date) from lineitem")
def g1_union_all(spark, sf):
    """Row-bind by name: two files that are read with one path list."""
    one = X.table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"))
    two = X.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"))
    return T.union_all([one, two])


@_query(
    """select o_orderkey, replace(translate(replace(replace(p[1], '&', 'and'), ' ', '_'), '''()#,', '_____'), '', '') as site from
 (select o_orderkey, string_split(o_orderpriority || ' & (' || o_orderstatus || ') #1, it''s.v2.geojson', '.') as p from orders)"""
)
def h2_clean_site_name(spark, sf):
    name = F.concat("o_orderpriority", F.lit(" & ("), "o_orderstatus", F.lit(") #1, it's.v2.geojson"))
    return X.table(spark, sf, "orders").select("o_orderkey", S.clean_site_name(name).alias("site"))


@_query("select o_orderkey, lpad(cast(o_custkey % 1000 as varchar), 3, '0') as chunk, round_even(o_totalprice / 7, 6) as r6 from orders")
def h4_zero_pad(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", S.zero_pad(F.col("o_custkey") % 1000).alias("chunk"), S.round6(F.col("o_totalprice").cast("double") / 7).alias("r6"))


@_query("select cell, cast(least(floor((cell-1) / greatest(floor((select count(*) from supplier) / 7), 1)), 6) + 1 as bigint) as chunk, x + 0.0 as x, y + 30.0 as y from grid", "grid")
def h11_chunk_of(spark, sf):
    n = X.table(spark, sf, "supplier").count()
    return X.grid(spark, sf).select("cell", S.chunk_of("cell", 7, F.lit(n)).alias("chunk"), "x", S.shift_point("y").alias("y"))


@_query(
    """, y as (select site_id, cell, cast(year(slot_date) as int) as year, max(vi) as hi, min(vi) as lo, sum(vi) as s, count(*) as n from curve
  join (select site_id, cell from good group by all) using (site_id, cell) group by all),
 o as (select site_id, cell, cast(year(obs_date) as int) as year, count(*) as seen from good group by all),
 d as (select site_id, cell, quantile_cont(vi, 0.05) filter (where vi > 0 and obs_date between date '1996-01-01' and date '2000-12-31') as dormant from vi group by all)
 select y.site_id, y.cell, y.year, round(hi*10000, 3) as EVImax, round((hi-lo)*10000, 3) as EVIamp, round(s*100, 3) as EVIarea, cast(seen as double) as numObs from y
 join o using (site_id, cell, year) join d using (site_id, cell) join water w using (cell)
 where hi between 0 and 1 and hi - lo between 0 and 1 and not (dormant < 0.05 and hi-lo < 0.3 and occ > 80) and not (dormant < 0.05 and hi-lo < 0.2 and occ > 30)
  and y.year between 1996 and 2000 and n >= 365""",
    "curve", "vi", "water",
)
def k15_annual_fallback(spark, sf):
    """Years without any cycle: the daily lines of the plain curve, none of which is high enough for the parameters given here."""
    rows = Q._arrays(spark, sf)
    s = X.series(spark, sf)
    days = F.array_sort(F.collect_list(F.struct(F.col("day_idx").alias("d"), F.col("vi").alias("v"))))
    seen = series.year_windows(s.where("vi is not null"), PARAMS.years).groupBy(*BY).agg(days.alias("o"))
    low = series.dormant_value(s, PARAMS.dormant_from, PARAMS.dormant_to)
    rows = rows.join(seen, BY).join(low, CELL).join(X.water(spark, sf), "cell")
    rows = rows.select(*BY, "curve", F.col("o.d").alias("days"), "dormant", "occ")
    out = P.annual_fallback(rows, PARAMS)
    return out.select(*BY, *(F.round(c, 3).alias(c) for c in ("EVImax", "EVIamp", "EVIarea")), "numObs")
