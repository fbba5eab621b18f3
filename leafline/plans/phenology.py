"""The whole chain: daily observations to 24 values for each cell and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import let
from ..operators.cycles import pheno_dates, qa_class, rank_cycles, segment_metrics, weak_cycle, with_segments
from ..operators.despike import despiked_arrays
from ..operators.series import KEYS
from ..operators.similarity import year_curves
from ..sources.tables import read_cells, scratch_path
from .params import LAYER_NAMES, Params

DATES = ["up1", "up2", "up3", "peak", "down1", "down2", "down3"]


def _window(year: int, p: Params) -> tuple[Column, Column]:
    """First and last day of a year's window."""
    first = F.date_add(F.lit(f"{year}-01-01").cast("date"), -p.spline_buffer)
    return first, F.date_add(first, p.slots - 1)


def _composited(obs: Column, p: Params) -> Column:
    """The largest value of every few days, at the middle one; days outside of all windows are left out."""
    first, last = _window(min(p.years), p)[0], _window(max(p.years), p)[1]
    bins = F.transform(F.filter(obs, lambda o: o["day"].between(first, last)), lambda o: F.struct(F.floor(F.datediff(o["day"], first) / p.composite_days).cast("int").alias("b"), o["v"].alias("v")))

    def merged(all_: Column) -> Column:
        top = lambda b: F.array_max(F.transform(F.filter(all_, lambda x: x["b"] == b), lambda x: x["v"]))
        return F.transform(F.array_distinct(F.transform(all_, lambda x: x["b"])), lambda b: F.struct(F.date_add(first, b * p.composite_days + p.composite_days // 2).alias("day"), top(b).alias("v")))

    return let(bins, merged)


def _low_quantile(values: Column, q: float) -> Column:
    """A quantile of an array by linear interpolation, null for an empty one."""

    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(q)
        low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
        between = (high - place) * F.get(v, low) + (place - low) * F.get(v, high)
        return F.when(low == high, F.get(v, low)).otherwise(between)

    return let(F.sort_array(values), lambda v: F.when(F.size(v) > 0, at(v)))


def cell_years(series: DataFrame, water: DataFrame, p: Params, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year, curve, days, values, num_obs, dormant, occ, is_water)``: all that cycles are looked for in.

    One shuffle, by the keys, makes a row of arrays of each series; despiking, quantile, gaps, windows,
    and quantile then are expressions on that row or pass it through Python in Arrow batches, as
    splines, likeness of years and refits do, together. ``windows`` holds a struct for each product year, so nothing is joined
    by year. A series that is stored in buckets of its keys needs no shuffle at all.
    """
    negative = F.avg(F.when(F.col("vi") < 0, 1.0).when(F.col("vi").isNotNull(), 0.0))
    cells = despiked_arrays(series, p, keys, negative_share=negative)
    occ = F.coalesce(F.col("occ").cast("double"), F.lit(0.0))
    cells = cells.join(water.select(keys[-1], "occ"), keys[-1], "left").withColumn("occ", occ)
    cells = cells.withColumn("is_water", F.coalesce((F.col("negative_share") > p.negative_share) & (F.col("occ") > p.water_low), F.lit(False)))
    pairs = F.arrays_zip(F.col("s_day").alias("day"), F.col("s_vi").alias("v"))
    cells = cells.select(*keys, "occ", "is_water", F.filter(pairs, lambda o: o["v"].isNotNull()).alias("obs"))
    period = [F.lit(d).cast("date") for d in (p.dormant_from, p.dormant_to)]
    low = F.transform(F.filter("obs", lambda o: (o["v"] > 0) & o["day"].between(*period)), lambda o: o["v"])
    cells = cells.withColumn("dormant", _low_quantile(low, p.dormant_quantile))
    raised = F.transform("obs", lambda o: F.struct(o["day"].alias("day"), F.when(o["v"] < F.col("dormant"), F.col("dormant")).otherwise(o["v"]).alias("v")))
    cells = cells.withColumn("obs", _composited(raised, p) if p.composite_days else raised)
    n = F.greatest(F.size("obs") - 1, F.lit(0))
    steps = F.zip_with(F.slice("obs", 1, n), F.slice("obs", 2, n), lambda a, b: F.struct(a["day"].alias("gap_start"), b["day"].alias("gap_end")))

    def window(year: int) -> Column:
        first, last = _window(year, p)
        seen = lambda obs: F.struct(F.lit(year).alias("year"), F.transform(obs, lambda o: F.datediff(o["day"], first) + 1).alias("xs"), F.transform(obs, lambda o: o["v"]).alias("ys"))
        return let(F.filter("obs", lambda o: o["day"].between(first, last)), seen)

    cells = cells.withColumns({
        "gaps": F.filter(steps, lambda g: F.datediff(g["gap_end"], g["gap_start"]) > p.gap_days), "windows": F.array(*map(window, p.years))
    }).drop("obs")
    cells = year_curves(cells, p).drop("gaps").withColumnRenamed("dormant", "_dormant")

    def told(i: int, year: int) -> Column:
        xs, ys = (F.get("windows", F.lit(i))[c] for c in ("xs", "ys"))
        seen = F.size(xs) > 0
        own = F.size(F.filter(xs, lambda x: x.between(p.spline_buffer + 1, p.spline_buffer + 365)))
        return F.struct(
            F.lit(year).alias("year"), F.get("curves", F.lit(i)).alias("curve"), F.when(seen, xs).alias("days"), F.when(seen, ys).alias("values"),
            own.cast("long").alias("num_obs"), F.when(seen, F.col("_dormant")).alias("dormant"),
        )

    years = F.inline(F.array(*(told(i, y) for i, y in enumerate(p.years))))
    return cells.select(*keys, "occ", "is_water", years).select(*keys, "year", "curve", "days", "values", "num_obs", "dormant", "occ", "is_water")


def _doy(slot: str, p: Params) -> Column:
    """A slot of the year's window as days since the last day of the year before."""
    return F.col(slot) - p.spline_buffer


def from_cell_years(rows: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year, 24 layers)``: cycles where there are any, annual values where there is none, or an empty row.

    Empty rows have only their quality, 4: water, no curve, values out of range, weak cycles in
    cells under water, and cycles without a known fit. A row for each cycle carries what its year
    needs, so that one shuffle, by cell and year, brings the two best together; nothing is joined.
    """
    by = [*keys, "year"]
    live = ~F.col("is_water") & F.col("curve").isNotNull()
    rows = rows.withColumns({"live": live, "annual": F.when(live, _annual(p))})
    within = F.filter("segs", lambda s: (s["seg_peak"] > p.spline_buffer) & (s["seg_peak"] <= p.spline_buffer + 365))
    segs = with_segments(rows.withColumn("curve", F.when(F.col("live"), F.col("curve"))), p).withColumn("_s", F.explode_outer(within))
    segs = segs.select(*by, "curve", "days", "values", "live", "annual", "dormant", "occ", "num_obs", "_s.*")
    segs = segment_metrics(pheno_dates(segs, p)).withColumn("peak", F.col("seg_peak"))
    segs = segs.withColumn("qa", qa_class("up_r2", "down_r2", "up_gap", "down_gap", p)).drop("curve", "days", "values")
    cols = [*DATES, "peak_value", "amp", "area", "qa"]
    picks = [F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in cols]
    unfit = F.max(F.when(F.col("seg_peak").isNotNull() & (F.col("rank") <= 2), F.col("qa").isNull())).alias("unfit")
    own = [F.first(c).alias(c) for c in ("live", "annual", "dormant", "occ", "num_obs")]
    years = rank_cycles(segs, by).groupBy(*by).agg(F.count("seg_peak").alias("n"), F.count("amp").alias("n_known"), unfit, *picks, *own)
    bad = F.coalesce(weak_cycle("dormant", "peak_value_1", "amp_1", "occ", p), F.lit(True)) | F.col("unfit")

    def layer(c: str, r: int) -> Column:
        name = f"{c}_{r}"
        if c in DATES:
            return _doy(name, p)
        return F.col(name) * {"peak_value": 10000, "amp": 10000, "area": 100, "qa": 1}[c]

    second = [F.coalesce(layer("qa", 2), F.lit(4)) if c == "qa" else layer(c, 2) for c in cols]
    values = [F.col("n_known"), *(layer(c, 1) for c in cols), *second, F.col("num_obs")]
    flat = _annual_layers("annual")
    years = years.withColumns({"hi": F.col("annual.hi"), "flat_amp": F.col("annual.hi") - F.col("annual.lo")})
    plain = F.col("live") & (F.col("n") == 0) & ~F.coalesce(weak_cycle("dormant", "hi", "flat_amp", "occ", p), F.lit(True))

    def chosen(name: str, cycle: Column) -> Column:
        empty = F.lit(4.0 if name in ("QA", "QA_2") else None).cast("double")
        return F.when((F.col("n") > 0) & ~bad, cycle.cast("double")).when(plain, flat.get(name, F.lit(None)).cast("double")).otherwise(empty).alias(name)

    return years.select(*by, *(chosen(n, v) for n, v in zip(LAYER_NAMES, values)))


def _annual(p: Params) -> Column:
    """``(hi, lo, s, n)`` of a row's curve and days in its calendar year."""
    length = F.dayofyear(F.make_date("year", F.lit(12), F.lit(31)))
    own_days = F.size(F.filter("days", lambda d: d.between(p.spline_buffer + 1, p.spline_buffer + length)))
    of = lambda c: F.struct(F.array_max(c).alias("hi"), F.array_min(c).alias("lo"), F.aggregate(c, F.lit(0.0), lambda s, v: s + v).alias("s"), own_days.alias("n"))
    return let(F.slice("curve", p.spline_buffer + 1, length), of)


def _annual_layers(annual: str) -> dict[str, Column]:
    hi, lo, s, n = (F.col(f"{annual}.{c}") for c in ("hi", "lo", "s", "n"))
    return {"NumCycles": F.lit(0), "EVImax": hi * 10000, "EVIamp": (hi - lo) * 10000, "EVIarea": s * 100, "QA": F.lit(4), "QA_2": F.lit(4), "numObs": n}


def annual_fallback(none: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year, 24 layers)`` of cell-years without a cycle: the values of the calendar year, if they are in range and not too weak.

    ``none`` has ``curve``, ``days``, ``dormant`` and ``occ``.
    """
    by = [*keys, "year"]
    flat = none.select(*by, "dormant", "occ", _annual(p).alias("a")).withColumns({"hi": F.col("a.hi"), "amp": F.col("a.hi") - F.col("a.lo")})
    flat, annual = flat.where(~F.coalesce(weak_cycle("dormant", "hi", "amp", "occ", p), F.lit(True))), _annual_layers("a")
    return flat.select(*by, *(annual.get(n, F.lit(None)).cast("double").alias(n) for n in LAYER_NAMES))


def phenology(series: DataFrame, water: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """The product of a table of daily observations ``(keys, obs_date, blue, red, vi)``, a row for each cell and year."""
    return from_cell_years(cell_years(series, water, p, keys), p, keys)


def explain_pixel(series: DataFrame, water: DataFrame, where: Column, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """The same chain for the cells of ``where``, with the curve and raw values beside the result.

    The condition is applied first: it wouldn't pass the grouped maps by itself. What cycles are
    looked for in is written to the shared folder, as the result and what stands beside it both need it.
    """
    path = scratch_path(series.sparkSession, "explained")
    cell_years(series.where(where), water, p, keys).write.parquet(path)
    rows = series.sparkSession.read.parquet(path)
    return from_cell_years(rows, p, keys).join(rows.select(*keys, "year", "curve", "days", "values"), [*keys, "year"], "left")


def explain_stored(
    spark: SparkSession, path: str, water: DataFrame, cells: list[int], n_chunks: int, n_cells: int, p: Params = Params(), keys: list[str] = KEYS
) -> DataFrame:
    """:func:`explain_pixel` for some cells of a stored table of daily observations in chunks: no other chunk is read."""
    rows = read_cells(spark, path, cells, n_chunks, n_cells, keys[-1]).drop("chunk")
    return explain_pixel(rows, water.where(F.col(keys[-1]).isin(sorted(cells))), F.lit(True), p, keys)
