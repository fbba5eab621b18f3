"""Keyed time series: neighbours, gaps, floors, composites, year windows and daily curves.

All windows are partitioned by the series' key, so a task holds one cell's few hundred dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import direction_code, evi2, floor_at, linear_interp, to_reflectance

KEYS = ["site_id", "cell"]


def vegetation_series(daily: DataFrame) -> DataFrame:
    """Daily mosaics as reflectance, with the vegetation index."""
    out = daily.withColumns({b: to_reflectance(b) for b in ("blue", "green", "red", "nir")})
    return out.withColumn("vi", evi2("nir", "red"))


def triplets(obs: DataFrame, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """Valid observations with the valid ones before and after: ``prev_date, prev_value, next_date, next_value``."""
    w = Window.partitionBy(*keys).orderBy(date)
    return obs.where(F.col(value).isNotNull()).select(
        *keys, date, value,
        F.lag(date).over(w).alias("prev_date"), F.lag(value).over(w).alias("prev_value"),
        F.lead(date).over(w).alias("next_date"), F.lead(value).over(w).alias("next_value"),
    )


def diff_series(obs: DataFrame, value: str, keys: list[str] = KEYS, order: str = "obs_date") -> DataFrame:
    """``d_value`` and, for dates, ``d_days``: what has changed since the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return obs.select(*keys, order, (F.col(value) - F.lag(value).over(w)).alias("d_value"), F.datediff(order, F.lag(order).over(w)).alias("d_days"))


def gap_islands(obs: DataFrame, days: int = 20, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """``(keys, gap_start, gap_end)``: valid dates more than ``days`` apart; the start is in the gap, the end is not."""
    valid = obs.where(F.col(value).isNotNull())
    prev = F.lag(date).over(Window.partitionBy(*keys).orderBy(date))
    gaps = valid.select(*keys, prev.alias("gap_start"), F.col(date).alias("gap_end"))
    return gaps.where(F.datediff("gap_end", "gap_start") > days)


def run_length(steps: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """``(keys, run, code, n, first)``: runs of steps in one direction (1 up, 2 down, 0 flat)."""
    w = Window.partitionBy(*keys).orderBy(order)
    coded = steps.select(*keys, order, direction_code(F.lead(value).over(w) - F.col(value)).alias("code"), F.lead(order).over(w).alias("_next"))
    coded = coded.where("_next is not null")
    new = F.when(F.col("code") == F.lag("code").over(w), 0).otherwise(1)
    runs = coded.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "run", "code").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def first_last_valid(obs: DataFrame, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    seen = F.when(F.col(value).isNotNull(), F.col(date))
    return obs.groupBy(*keys).agg(F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"))


def three_day_composite(obs: DataFrame, origin: str | Column, end: str | Column, days: int = 3, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """The largest value of every ``days`` days counted from ``origin``, at the middle day; empty bins give no row."""
    start, stop = (F.lit(d).cast("date") for d in (origin, end))
    inside = obs.where(F.col(value).isNotNull() & F.col(date).between(start, stop))
    b = F.floor(F.datediff(date, start) / days).cast("int")
    return inside.groupBy(*keys, b.alias("_bin")).agg(F.max(value).alias(value)).select(
        *keys, F.date_add(start, F.col("_bin") * days + days // 2).alias(date), value
    )


def _dormant(value: str, date: str, first: str, last: str) -> Column:
    return F.when((F.col(value) > 0) & F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col(value))


def dormant_value(obs: DataFrame, first: str, last: str, q: float = 0.05, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """A low quantile of positive values in the dormant period, by linear interpolation."""
    return obs.groupBy(*keys).agg(F.percentile(_dormant(value, date, first, last), F.lit(q)).alias("dormant"))


def floor_dormant(obs: DataFrame, first: str, last: str, q: float = 0.05, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """``obs`` with ``dormant``, and values below it raised to it."""
    low = F.percentile(_dormant(value, date, first, last), F.lit(q)).over(Window.partitionBy(*keys))
    return obs.withColumn("dormant", low).withColumn(value, floor_at(value, "dormant"))


def negative_share(obs: DataFrame, value: str = "vi", keys: list[str] = KEYS) -> DataFrame:
    return obs.groupBy(*keys).agg(F.avg(F.when(F.col(value) < 0, 1.0).when(F.col(value).isNotNull(), 0.0)).alias("negative_share"))


def water_reject(obs: DataFrame, water: DataFrame, share: float = 0.5, occurrence: float = 30.0, keys: list[str] = KEYS, on: str = "cell") -> DataFrame:
    """``(keys, negative_share, occ, is_water)`` for each series; cells without an occurrence count as land."""
    occ = F.coalesce(F.col("occ").cast("double"), F.lit(0.0))
    flag = F.coalesce((F.col("negative_share") > share) & (occ > occurrence), F.lit(False))
    return negative_share(obs, keys=keys).join(water.select(on, "occ"), on, "left").select(*keys, "negative_share", occ.alias("occ"), flag.alias("is_water"))


def year_table(spark: SparkSession, years: tuple[int, ...], buffer: int = 185) -> DataFrame:
    """``(year, win_start, win_end)``: a row for each product year, always few."""
    y = spark.range(1).select(F.explode(F.array(*map(F.lit, years))).alias("year"))
    start = F.date_add(F.make_date("year", F.lit(1), F.lit(1)), -buffer)
    return y.select("year", start.alias("win_start"), F.date_add(start, 364 + 2 * buffer).alias("win_end"))


def year_windows(obs: DataFrame, years: tuple[int, ...], buffer: int = 185, date: str = "obs_date") -> DataFrame:
    """``obs`` once for each year window that it falls in, with ``year`` and ``day_idx`` from 1."""
    w = F.broadcast(year_table(obs.sparkSession, years, buffer))
    inside = F.col(date).between(F.col("win_start"), F.col("win_end"))
    return obs.join(w, inside).withColumn("day_idx", F.datediff(date, "win_start") + 1).drop("win_start", "win_end")


def num_obs(windowed: DataFrame, buffer: int = 185, value: str = "vi", keys: list[str] = KEYS) -> DataFrame:
    """Observed days in the slots of the year itself."""
    own = F.col("day_idx").between(buffer + 1, buffer + 365) & F.col(value).isNotNull()
    return windowed.groupBy(*keys, "year").agg(F.count_if(own).alias("num_obs"))


def attach_daily_spine(windowed: DataFrame, years: tuple[int, ...], buffer: int = 185, keys: list[str] = KEYS, value: str = "vi") -> DataFrame:
    """Every slot of every year window of each series, with the value observed there or null."""
    w = year_table(windowed.sparkSession, years, buffer)
    spine = windowed.select(*keys).distinct().crossJoin(F.broadcast(w.select("year", "win_start")))
    slots = spine.select(*keys, "year", "win_start", F.explode(F.sequence(F.lit(1), F.lit(365 + 2 * buffer))).alias("day_idx"))
    slots = slots.select(*keys, "year", "day_idx", F.date_add("win_start", F.col("day_idx") - 1).alias("slot_date"))
    return slots.join(windowed.select(*keys, "year", "day_idx", value), [*keys, "year", "day_idx"], "left")


def gap_slots(obs: DataFrame, first: str, last: str, days: int = 20, keys: list[str] = KEYS, value: str = "vi", date: str = "obs_date") -> DataFrame:
    """``(keys, slot_date)``: days of the period that lie in a gap."""
    gaps = gap_islands(obs, days, value, keys, date)
    start, end = F.greatest("gap_start", F.lit(first).cast("date")), F.least(F.date_add("gap_end", -1), F.lit(last).cast("date"))
    return gaps.where(start <= end).select(*keys, F.explode(F.sequence(start, end)).alias("slot_date"))


def years_with_gaps(obs: DataFrame, years: tuple[int, ...], days: int = 20, buffer: int = 185, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year)``: windows that a gap reaches into."""
    w = F.broadcast(year_table(obs.sparkSession, years, buffer))
    gaps = gap_islands(obs, days, keys=keys)
    return gaps.join(w, (F.col("gap_start") <= F.col("win_end")) & (F.col("gap_end") > F.col("win_start"))).select(*keys, "year").distinct()


def interpolated_curve(obs: DataFrame, value: str = "vi", keys: list[str] = KEYS, date: str = "obs_date", digits: int = 6) -> DataFrame:
    """``(keys, slot_date, value)``: each day between valid observations, on the straight line between them."""
    w = Window.partitionBy(*keys).orderBy(date)
    seg = obs.where(F.col(value).isNotNull()).select(
        *keys, F.col(date).alias("d1"), F.col(value).alias("v1"), F.lead(date).over(w).alias("d2"), F.lead(value).over(w).alias("v2")
    )
    last_day = F.when(F.col("d2").isNull(), F.col("d1")).otherwise(F.date_add("d2", -1))
    days = seg.select("*", F.explode(F.sequence("d1", last_day)).alias("slot_date"))
    line = linear_interp(
        F.datediff("slot_date", "d1").cast("double"), F.lit(0.0), F.col("v1"), F.datediff("d2", "d1").cast("double"), F.col("v2")
    )
    return days.select(*keys, "slot_date", F.round(F.when(F.col("d2").isNull(), F.col("v1")).otherwise(line), digits).alias(value))
