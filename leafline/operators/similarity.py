"""Likeness of years, and refits that borrow observations of like years for gaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.scalar import let
from ..plans.params import Params
from .batches import in_parts, offsets
from .series import KEYS
from .spline import gathered, smooth, smoothing_splines

CELLS = 64  # whose years are smoothed together


def slot_values(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year, vs)`` from ``(keys, year, day_idx, v)``: the value of each slot from 0 up to the last, null where there is none."""
    one = F.struct(F.col("day_idx").alias("d"), "v")
    o = rows.where("v is not null").groupBy(*keys, "year").agg(F.sort_array(F.collect_list(one)).alias("o"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("o.d", i - 1))
    filled = F.transform("o", lambda r, i: F.concat(F.array_repeat(F.lit(None).cast("double"), r["d"] - before(i) - 1), F.array(r["v"])))
    start = F.get("o.d", F.lit(0))
    whole = F.element_at("o.d", -1) - start + 1 == F.size("o")
    lead = F.array_repeat(F.lit(None).cast("double"), start)
    return o.select(*keys, "year", F.when(whole, F.concat(lead, F.col("o.v"))).otherwise(F.flatten(filled)).alias("vs"))


def _total(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def masked_year(year: Column, vs: Column) -> Column:
    """A year's masked curve as :func:`year_pairs` takes it, with its mean."""
    return F.struct(year.alias("year"), vs.alias("vs"), (_total(vs) / F.nullif(F.size(F.filter(vs, lambda v: v.isNotNull())), F.lit(0))).alias("m"))


def year_pairs(every: Column | str, p: Params = Params()) -> Column:
    """``(year, other, n, weight)`` of all pairs of an array of :func:`masked_year` that have a slot in common."""

    def pair(a: Column, b: Column) -> Column:
        far = F.zip_with(a["vs"], b["vs"], lambda x, y: (y - x) * (y - x))
        flat = F.zip_with(a["vs"], b["vs"], lambda x, y: F.when(y.isNotNull(), (x - a["m"]) * (x - a["m"])))
        n = lambda ds: F.size(F.filter(ds, lambda d: d.isNotNull())).cast("long")
        apart = let(far, lambda ds: F.struct(n(ds).alias("n"), F.sqrt(_total(ds)).alias("far")))
        return F.struct(a["year"].alias("year"), b["year"].alias("other"), apart.alias("apart"), F.sqrt(_total(flat)).alias("flat"))

    def weighed(s: Column) -> Column:
        n, flat = s["apart"]["n"], s["flat"]
        like = F.lit(p.max_weight) * F.greatest(F.lit(0.0), 1 - F.try_divide(s["apart"]["far"], flat))
        return F.struct(s["year"].alias("year"), s["other"].alias("other"), n.alias("n"), F.when((n < p.min_common_days) | (flat == 0), 0.0).otherwise(like).alias("weight"))

    pairs = F.flatten(F.transform(every, lambda a: F.transform(every, lambda b: pair(a, b))))
    return F.transform(F.filter(pairs, lambda s: s["apart"]["n"] > 0), weighed)


def array_weights(curves: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """:func:`year_weights` from ``(keys, year, vs)``, where ``vs`` has a value or null for each slot.

    The few years of a cell meet in one row, and their distances are sums over its arrays: no
    slot becomes a row, and only the arrays are shuffled, by cell.
    """
    cells = curves.groupBy(*keys).agg(F.collect_list(masked_year(F.col("year"), F.col("vs"))).alias("all"))
    return cells.select(*keys, F.inline(year_pairs("all", p)))


def year_weights(curves: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year, other, n, weight)`` from masked curves ``(keys, year, day_idx, v)``.

    The weight is 1 less the distance of the other year's curve over that of a constant at the
    year's own mean, on common slots, at least 0, times ``max_weight``; 0 with too few common
    slots or where it can't be told.
    """
    return array_weights(slot_values(curves, keys), p, keys)


def refit_points(windowed: DataFrame, gaps: DataFrame, weights: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """Weighted points of every year window with a gap: its own at 1, others' by likeness where it has a gap.

    ``windowed`` has ``(keys, year, day_idx, vi, dormant)``; ``gaps`` ``(keys, gap_start, gap_end)``.
    Slots before the year go by the likeness of the year before, those after by the year after,
    as far as there are such years.
    """
    first, last = min(p.years), max(p.years)
    seen = windowed.select(*keys, "dormant").distinct()
    spans = gaps.groupBy(*keys).agg(F.collect_list(F.struct("gap_start", "gap_end")).alias("gaps"))
    year = F.explode(F.array(*(F.lit(y) for y in p.years)))
    start = F.date_add(F.make_date("target", F.lit(1), F.lit(1)), -p.spline_buffer)
    targets = seen.join(spans, keys).select(*keys, "gaps", year.alias("target")).withColumn("win_start", start)
    end = F.date_add("win_start", p.slots - 1)
    targets = targets.where(F.exists("gaps", lambda g: (g["gap_start"] <= end) & (g["gap_end"] > F.col("win_start"))))
    rows = windowed.where("vi is not null").select(*keys, F.col("year").alias("other"), "day_idx", "vi", "dormant").join(targets, keys)
    slot = F.date_add("win_start", F.col("day_idx") - 1)
    rows = rows.withColumn("in_gap", F.exists("gaps", lambda g: (g["gap_start"] <= slot) & (slot < g["gap_end"])))
    rows = rows.where(F.col("in_gap") | (F.col("other") == F.col("target")))
    near = F.when(F.col("day_idx") <= p.spline_buffer, F.greatest(F.col("target") - 1, F.lit(first)))
    near = near.when(F.col("day_idx") > p.spline_buffer + 365, F.least(F.col("target") + 1, F.lit(last))).otherwise(F.col("target"))
    like = weights.select(*keys, F.col("year").alias("like"), "other", "weight")
    rows = rows.withColumn("like", near).join(like, [*keys, "like", "other"], "left")
    w = F.when(F.col("other") == F.col("target"), 1.0).otherwise(F.coalesce("weight", F.lit(0.0)))
    return rows.select(*keys, F.col("target").alias("year"), "other", "day_idx", "vi", "dormant", w.alias("w")).where("w > 0")


def gap_fill_refit(points: DataFrame, p: Params = Params(), keys: list[str] = KEYS) -> DataFrame:
    """``(keys, year, curve)`` of the points of :func:`refit_points`."""
    return smooth(gathered(points, [*keys, "year"], w="w"), [*keys, "year"], p.slots, p.spar)


def _sum(values: np.ndarray) -> np.ndarray:
    """Sums over the last axis, added one after another as :func:`year_pairs` does; unknown values count 0."""
    return np.cumsum(np.nan_to_num(values), axis=-1)[..., -1]


def cell_weights(vs: np.ndarray, p: Params = Params()) -> np.ndarray:
    """The weights of :func:`year_pairs` as ``[cell, year, other]`` from masked curves ``[cell, year, day]``; NaN where there is no value."""
    seen = ~np.isnan(vs)
    with np.errstate(invalid="ignore", divide="ignore"):
        off = (vs - (_sum(vs) / seen.sum(axis=-1))[..., None]) ** 2
        out = np.zeros((*vs.shape[:2], vs.shape[1]))
        for a in range(vs.shape[1]):
            for b in range(vs.shape[1]):
                n = (seen[:, a] & seen[:, b]).sum(axis=-1)
                far, flat = np.sqrt(_sum((vs[:, b] - vs[:, a]) ** 2)), np.sqrt(_sum(np.where(seen[:, b], off[:, a], np.nan)))
                out[:, a, b] = np.where((n < max(p.min_common_days, 1)) | (flat == 0), 0.0, p.max_weight * np.maximum(0.0, 1 - far / flat))
    return out


def gap_days(cell: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, p: Params = Params()) -> np.ndarray:
    """Whether slots lie in a gap, as ``[cell, year, slot]``; ``start`` and ``end`` are days since 1970 of the gaps of ``cell``."""
    first = np.array([f"{y}-01-01" for y in p.years], "datetime64[D]").astype(int) - p.spline_buffer
    steps = np.zeros((n, len(first), p.slots + 1), int)
    year = np.arange(len(first))[None]
    for day, step in ((start, 1), (end, -1)):
        np.add.at(steps, (cell[:, None], year, np.clip(day[:, None] - first, 0, p.slots)), step)
    return steps.cumsum(axis=2)[:, :, :-1] > 0


def year_curves(cells: DataFrame, p: Params = Params(), out: str = "curves") -> DataFrame:
    """``cells`` with ``out``: the daily curve of each of ``windows``, gaps filled from like years, raised to ``dormant`` where below.

    ``windows`` has ``(year, xs, ys)`` for each product year, the slots and values observed there, and ``gaps``
    ``(gap_start, gap_end)``. Each year is smoothed; a year whose window a gap reaches into is smoothed again
    with the observations of other years in its gaps, weighted by how like the years' first curves are (slots
    before the year: by the likeness of the year before, slots after: of the year after, as far as there are
    such years). A curve that can't be fitted is null. The row stays one row, so nothing is shuffled.
    """
    at, n_years, b = np.arange(1, p.slots + 1, dtype=float), len(p.years), p.spline_buffer
    place = {y: i for i, y in enumerate(p.years)}
    near = [[place.get(y, n_years) for y in (max(year - 1, min(p.years)), year, min(year + 1, max(p.years)))] for year in p.years]
    lengths = np.array([366 if (y % 4 == 0 and y % 100 != 0) or y % 400 == 0 else 365 for y in p.years])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        windows = batch.column("windows").flatten()
        xs, ys = (pc.struct_field(windows, c) for c in ("xs", "ys"))
        of = np.repeat(np.arange(n * n_years), pc.list_value_length(xs).to_numpy())
        x, y = (v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys))
        low = np.repeat(pc.cast(batch.column("dormant"), pa.float64()).to_numpy(zero_copy_only=False), n_years)[:, None]
        gaps = batch.column("gaps")
        start, end = (pc.struct_field(gaps.flatten(), c).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in ("gap_start", "gap_end"))
        in_gap = gap_days(np.repeat(np.arange(n), pc.list_value_length(gaps).to_numpy()), start, end, n, p)

        def fitted(curve: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            fit = smoothing_splines(curve, x.astype(float), y, w, n * n_years, at, p.spar)
            fit = np.where(fit < low, low, fit)
            fit[~np.isfinite(fit).all(axis=1)] = np.nan
            return fit

        curves = fitted(of, x, y, np.ones(len(x)))
        if in_gap.any():
            ends = np.full(n * n_years, p.slots + 1), np.zeros(n * n_years, int)
            np.minimum.at(ends[0], of, x)
            np.maximum.at(ends[1], of, x)
            masked = np.where((at >= ends[0][:, None]) & (at <= ends[1][:, None]), curves, np.nan).reshape(n, n_years, -1)
            masked = np.where(in_gap, np.nan, masked)[:, :, b : b + 366]
            masked = np.where(np.arange(masked.shape[2]) < lengths[:, None], masked, np.nan)
            like = np.zeros((n, n_years + 1, n_years))
            like[:, :-1] = cell_weights(masked, p)
            cell, other = np.divmod(of, n_years)
            side = np.where(x <= b, 0, np.where(x > b + 365, 2, 1))
            points = []
            for i in range(n_years):
                w = np.where(other == i, 1.0, like[cell, np.array(near[i])[side], other])
                keep = np.flatnonzero(in_gap[:, i].any(axis=1)[cell] & (w > 0) & ((other == i) | in_gap[cell, i, x - 1]))
                points.append((cell[keep] * n_years + i, x[keep], y[keep], w[keep]))
            again = [np.concatenate(c) for c in zip(*points)]
            filled = np.bincount(again[0], minlength=len(curves)) > 0
            curves[filled] = fitted(*again)[filled]
        known = np.isfinite(curves).all(axis=1)
        lists = pa.ListArray.from_arrays(offsets(np.where(known, p.slots, 0)), curves[known].ravel(), mask=pa.array(~known))
        each = pa.ListArray.from_arrays(offsets(np.full(n, n_years)), lists)
        return pa.RecordBatch.from_arrays([*batch.columns, each], names=[*batch.schema.names, out])

    schema = StructType([*cells.schema.fields, StructField(out, ArrayType(ArrayType(DoubleType())))])
    return cells.mapInArrow(in_parts(work, CELLS), schema)
