"""Peaks, growth cycles, their dates, metrics and quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.scalar import direction_code, free_name, let, round6
from ..plans.params import Params
from .batches import in_parts, offsets
from .series import KEYS

CURVES = 256  # whose cycles are looked for together


def find_peaks(curve: DataFrame, keys: list[str], slot: str = "day_idx", value: str = "v") -> DataFrame:
    """``(keys, peak, value)``: slots where a rise turns into a fall, the middle of a flat top; never an end."""
    w = Window.partitionBy(*keys).orderBy(slot)
    top = F.lead(value).over(w)
    step = curve.select(*keys, slot, top.alias("_top"), direction_code(top - F.col(value)).alias("code")).where("code <> 0")
    turn = step.select(*keys, slot, "_top", "code", F.lead("code").over(w).alias("then"), F.lead(slot).over(w).alias("at"))
    mid = F.col(slot) + 1 + F.bround((F.col("at") - F.col(slot) - 1) / 2).cast("int")
    # all of a flat top has the value that the rise leads to
    return turn.where("code = 1 and then = 2").select(*keys, mid.alias("peak"), F.col("_top").alias(value))


def peaks_by_magnitude(peaks: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """``peaks`` with ``place``: from the smallest value, ties by slot."""
    return peaks.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(value, "peak")))


def turning_points(x: np.ndarray) -> np.ndarray:
    """The same for one array, from 0, by rising value."""
    code = np.sign(np.diff(x))
    at = np.flatnonzero(code)
    up = (code[at[:-1]] > 0) & (code[at[1:]] < 0)
    i, j = at[:-1][up], at[1:][up]
    peaks = i + 1 + np.rint((j - i - 1) / 2).astype(int)
    return peaks[np.argsort(x[peaks], kind="stable")]


def segments(x: np.ndarray, p: Params) -> list[tuple[int, int, int]]:
    """Start, peak and end of valid cycles, from 1, by rising peak.

    A peak is valid if the curve falls by the threshold on both sides before the next live peak or
    the longest length; a rejected peak stops living, so that larger ones search past it.
    """
    year = x[p.spline_buffer : p.spline_buffer + 365]
    if not len(year):
        return []
    threshold = max(p.min_seg_amplitude, p.rel_amp_frac * (year.max() - year.min()))
    order = turning_points(x)
    live, out = sorted(order.tolist()), []
    for peak in order.tolist():
        here = live.index(peak)
        a = max(0, peak - p.max_increase, *live[max(0, here - 1) : here])
        left = x[a : peak + 1]
        start = a + int(np.flatnonzero(left == left.min())[-1])
        if x[peak] - x[start] >= threshold and x[peak] >= 0:
            b = min(len(x) - 1, peak + p.max_decrease, *live[here + 1 : here + 2])
            right = x[peak : b + 1]
            end = peak + int(np.flatnonzero(right == right.min())[0])
            if x[peak] - x[end] >= threshold:
                out.append((start + 1, peak + 1, end + 1))
                continue
        live.remove(peak)
    return out


def find_segments(curves: DataFrame, keys: list[str], p: Params = Params()) -> DataFrame:
    """``(keys, curve, segs)``: the cycles of each row's ``curve``; row by row, as each peak depends on smaller ones."""

    return with_segments(curves.select(*keys, F.col("curve").cast("array<double>").alias("curve")), p)


def with_segments(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """``rows`` with ``segs``, the cycles of each row's ``curve`` as :func:`find_segments` tells them; no other column is touched."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [segments(c.values.to_numpy(), p) if c.is_valid else [] for c in batch.column("curve")]
        flat = [s for x in found for s in x]
        cols = [pa.array([s[k] for s in flat], pa.int32()) for k in range(3)]
        segs = pa.StructArray.from_arrays(cols, names=["seg_start", "seg_peak", "seg_end"])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets([len(x) for x in found]), segs)], names=[*batch.schema.names, "segs"])

    segs = ArrayType(StructType([StructField(n, IntegerType()) for n in ("seg_start", "seg_peak", "seg_end")]))
    return rows.mapInArrow(in_parts(work, CURVES), StructType([*rows.schema.fields, StructField("segs", segs)]))


def _at(slot: str | Column) -> Column:
    return F.element_at("curve", F.col(slot) if isinstance(slot, str) else slot)


def _limb(a: str, b: str) -> Column:
    return F.slice("curve", F.col(a), F.col(b) - F.col(a) + 1)


def pheno_dates(segs: DataFrame, p: Params = Params()) -> DataFrame:
    """``segs`` (``curve``, ``seg_start``, ``seg_peak``, ``seg_end``) with slots ``up1..3`` and ``down1..3``.

    Up: the first slot of the rising limb at a share of its amplitude or more; down: the last slot
    of the falling limb. Both sides are rounded to six places.
    """

    def levels(base: str, shares: tuple[float, ...]) -> list[Column]:
        return [round6(_at(base) + (_at("seg_peak") - _at(base)) * F.lit(s)) for s in shares]

    def first(limb: Column, base: str, shares: tuple[float, ...]) -> Column:
        """The first place of the limb at each share or more."""
        at = lambda xs, level: let(level, lambda low: F.array_position(F.transform(xs, lambda x: x >= low), True).cast("int"))
        return let(F.transform(limb, round6), lambda xs: F.array(*(at(xs, level) for level in levels(base, shares))))

    rise, fall = _limb("seg_start", "seg_peak"), _limb("seg_peak", "seg_end")
    found = F.struct(
        first(rise, "seg_start", p.green_up).alias("up"), first(F.reverse(fall), "seg_end", p.green_down).alias("down"), F.size(fall).alias("n")
    )
    f = free_name(segs, "_found")
    up = {f"up{i + 1}": F.col(f)["up"][i] + F.col("seg_start") - 1 for i in range(len(p.green_up))}
    down = {f"down{i + 1}": F.col(f)["n"] - F.col(f)["down"][i] + F.col("seg_peak") for i in range(len(p.green_down))}
    return segs.withColumn(f, found).withColumns(up | down).drop(f)


def segment_metrics(segs: DataFrame) -> DataFrame:
    """``segs`` with amplitude, maximum and sum of the curve, and for each limb fit, count and longest gap.

    ``days`` and ``values`` are the row's observations in order of slot. Without observations on
    either limb all are null; a fit is null where the observations don't vary.
    """

    def limb(a: str, b: str) -> Column:
        seen = F.filter(F.arrays_zip(F.col("days").alias("d"), F.col("values").alias("v")), lambda o: o["d"].between(F.col(a), F.col(b)))

        def fit(obs: Column) -> Column:
            mean = F.try_divide(F.aggregate(obs, F.lit(0.0), lambda s, o: s + o["v"]), F.size(obs))
            sse = F.aggregate(obs, F.lit(0.0), lambda s, o: s + F.pow(o["v"] - F.element_at("curve", o["d"]), 2))
            sst = let(mean, lambda m: F.aggregate(obs, F.lit(0.0), lambda s, o: s + F.pow(o["v"] - m, 2)))
            return let(sst, lambda all_: F.when(all_ != 0, 1 - sse / all_))

        def gap(obs: Column) -> Column:
            stops = F.concat(F.array(F.col(a)), F.transform(obs, lambda o: o["d"]), F.array(F.col(b)))
            n = F.size(obs)
            return let(stops, lambda at: F.array_max(F.zip_with(F.slice(at, 2, n + 1), F.slice(at, 1, n + 1), lambda later, sooner: later - sooner)))

        return let(seen, lambda obs: F.struct(fit(obs).alias("r2"), F.size(obs).alias("n"), gap(obs).alias("gap")))

    whole = _limb("seg_start", "seg_end")
    cols = {"amp": F.array_max(whole) - F.array_min(whole), "peak_value": F.array_max(whole), "area": F.aggregate(whole, F.lit(0.0), lambda s, v: s + v)}
    f = free_name(segs, "_limbs")
    limbs = F.struct(limb("seg_start", "seg_peak").alias("up"), limb("seg_peak", "seg_end").alias("down"))
    cols |= {f"{side}_{c}": F.col(f)[side][c] for side in ("up", "down") for c in ("r2", "n", "gap")}
    both = (F.col(f)["up"]["n"] > 0) & (F.col(f)["down"]["n"] > 0)
    return segs.withColumn(f, limbs).withColumns({k: F.when(both, c) for k, c in cols.items()}).drop(f)


def qa_class(up_r2: str, down_r2: str, up_gap: str, down_gap: str, p: Params = Params()) -> Column:
    """1 if the poorer fit and the longer gap of the limbs are both good, 2 if one is, 3 if neither; null without a fit."""
    fit, gap = F.least(up_r2, down_r2) >= p.qa_r2, F.greatest(up_gap, down_gap) <= p.qa_gap
    known = F.col(up_r2).isNotNull() & F.col(down_r2).isNotNull()
    return F.when(known, F.when(fit & gap, 1).when(fit | gap, 2).otherwise(3))


def weak_cycle(dormant: str, peak_value: str, amp: str, occ: str, p: Params = Params()) -> Column:
    """Whether a cycle is out of range or too weak for a cell that is under water at times."""
    v, a, low, o = F.col(peak_value), F.col(amp), F.col(dormant) < p.dormant_low, F.col(occ)
    outside = ~(v.between(0, 1) & a.between(0, 1))
    return outside | (low & (a < p.weak_high) & (o > p.water_high)) | (low & (a < p.weak_low) & (o > p.water_low))


def rank_cycles(segs: DataFrame, keys: list[str], amp: str = "amp", tie: str = "seg_peak") -> DataFrame:
    """``segs`` with ``rank``: by falling amplitude, unknown ones last, ties by ``tie``."""
    return segs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(amp).desc_nulls_last(), tie)))


def top2_cycles(ranked: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``(keys, n_cycles, c_1, c_2 …)``: the columns of the two largest cycles side by side."""
    picks = [F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in (1, 2) for c in cols]
    return ranked.groupBy(*keys).agg(F.count("*").alias("n_cycles"), *picks)


def annual_metrics(curve: DataFrame, keys: list[str] = KEYS, date: str = "slot_date", value: str = "v") -> DataFrame:
    """``(keys, year, EVImax, EVIamp, EVIarea)`` of a daily curve in calendar years, scaled as in the product."""
    y = F.year(date).alias("year")
    out = curve.where(F.col(value).isNotNull()).groupBy(*keys, y).agg(F.max(value).alias("hi"), F.min(value).alias("lo"), F.sum(value).alias("s"))
    return out.select(*keys, "year", (F.col("hi") * 10000).alias("EVImax"), ((F.col("hi") - F.col("lo")) * 10000).alias("EVIamp"), (F.col("s") * 100).alias("EVIarea"))


def peaks_in_year(segs: DataFrame, buffer: int = 185) -> DataFrame:
    return segs.where((F.col("seg_peak") > buffer) & (F.col("seg_peak") <= buffer + 365))
