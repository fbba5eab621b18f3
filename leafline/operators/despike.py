"""Spikes: one pass as window expressions, and the fixpoint over arrays of whole series."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.params import Params
from .batches import in_parts, offsets
from .series import KEYS

SERIES = 64  # that are despiked before the next are looked at

#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745


def despike_pass(obs: DataFrame, p: Params = Params(), keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """Valid observations with ``spike`` and its three causes ``cloud``, ``dip`` and ``jump``.

    An observation is compared with the valid ones before and after it; the first and the last of
    a series are never spikes. ``cloud``: blue rises and red doesn't rise alike, from both sides;
    ``dip``: the index is far below the line between its neighbours; ``jump``: its double
    difference is out of the series' range. Tests that can't be told are false.
    """
    w, whole = Window.partitionBy(*keys).orderBy(date), Window.partitionBy(*keys)
    good = obs.where(F.col("blue").isNotNull() & F.col("red").isNotNull() & F.col("vi").isNotNull())
    cols = {f"{c}{i}": f(c).over(w) for c in (date, "blue", "red", "vi") for i, f in ((1, F.lag), (3, F.lead))}
    t = good.withColumns(cols).withColumn("inner", F.col(f"{date}1").isNotNull() & F.col(f"{date}3").isNotNull())
    d1, d3 = F.datediff(date, f"{date}1"), F.datediff(f"{date}3", date)

    def rises(i: int, days):
        blue, red = F.col("blue") - F.col(f"blue{i}"), F.col("red") - F.col(f"red{i}")
        return (blue > F.lit(0.03) * (1 + days / 30)) & (red < F.lit(1.5) * blue)

    e1, e2, e3 = F.col("vi1"), F.col("vi"), F.col("vi3")
    dev = e1 + (e3 - e1) * F.try_divide(d1.cast("double"), (d1 + d3).cast("double")) - e2
    dip = (dev > p.min_residual) & (F.abs(dev) > p.spike_ratio * F.abs(e3 - e1)) & (d1 + d3 < p.max_distance)
    t = t.withColumn("dd", F.when(F.col("inner"), (e2 - e1) - (e3 - e2)))
    t = t.withColumn("md", F.median("dd").over(whole))
    center = F.col("dd") if p.mad_center == "standard" else e2
    t = t.withColumn("mad", F.median(F.when(F.col("inner"), F.abs(center - F.col("md")))).over(whole))
    reach = F.lit(p.mad_factor) * F.col("mad") / MAD_SCALE
    tests = {
        "cloud": rises(1, d1) & rises(3, d3),
        "dip": dip,
        "jump": (F.col("dd") < F.col("md") - reach) | (F.col("dd") > F.col("md") + reach),
    }
    t = t.withColumns({k: F.coalesce(F.col("inner") & v, F.lit(False)) for k, v in tests.items()})
    return t.select(*obs.columns, *tests, (F.col("cloud") | F.col("dip") | F.col("jump")).alias("spike"))


def spike_flags(blue: np.ndarray, red: np.ndarray, vi: np.ndarray, days: np.ndarray, p: Params) -> np.ndarray:
    """The same tests on one series in date order, repeated on what is left until nothing is flagged."""
    out = np.zeros(len(vi), bool)
    good = np.isfinite(blue) & np.isfinite(red) & np.isfinite(vi)
    for _ in range(p.max_despike_passes):
        at = np.flatnonzero(good & ~out)
        if len(at) < 3:
            break
        b, r, e, d = blue[at], red[at], vi[at], days[at].astype(float)
        before, after = d[1:-1] - d[:-2], d[2:] - d[1:-1]

        def rises(x: np.ndarray, y: np.ndarray, gap: np.ndarray) -> np.ndarray:
            return (x > 0.03 * (1 + gap / 30)) & (y < 1.5 * x)

        cloud = rises(b[1:-1] - b[:-2], r[1:-1] - r[:-2], before) & rises(b[1:-1] - b[2:], r[1:-1] - r[2:], after)
        span = e[2:] - e[:-2]
        with np.errstate(invalid="ignore", divide="ignore"):
            dev = e[:-2] + span * (before / (before + after)) - e[1:-1]
            dip = (dev > p.min_residual) & (np.abs(dev) > p.spike_ratio * np.abs(span)) & (before + after < p.max_distance)
        dd = (e[1:-1] - e[:-2]) - (e[2:] - e[1:-1])
        md = np.median(dd)
        mad = np.median(np.abs((dd if p.mad_center == "standard" else e[1:-1]) - md))
        reach = p.mad_factor * mad / MAD_SCALE
        flagged = cloud | dip | (dd < md - reach) | (dd > md + reach)
        if not flagged.any():
            break
        out[at[1:-1][flagged]] = True
    return out


def despiked_arrays(obs: DataFrame, p: Params = Params(), keys: list[str] = KEYS, date: str = "obs_date", **more: Column) -> DataFrame:
    """``(keys, more, s_day, s_vi)``: one row for each series, its days in order and their values, null at spikes.

    Passes repeat until no further spike is found. A pass depends on the last one's survivors, so a
    series goes to Python whole: one row with arrays for each cell, many cells in an Arrow batch.
    ``more`` are aggregates of the same shuffle.
    """
    one = F.struct(F.col(date).alias("day"), "vi", "blue", "red")
    rows = obs.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("s"), *(c.alias(n) for n, c in more.items()))
    values = [F.col(f"s.{c}").cast("array<double>").alias(f"s_{c}") for c in ("blue", "red", "vi")]
    arrays = rows.select(*keys, *more, F.col("s.day").alias("s_day"), *values)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        days, *rest = (batch.column(batch.num_columns - 4 + i) for i in range(4))
        when = days.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
        blue, red, vi = (c.flatten().to_numpy(zero_copy_only=False) for c in rest)
        ends = offsets(days.value_lengths().to_numpy())
        out = vi.copy()
        for a, b in pairwise(ends):
            out[a:b][spike_flags(blue[a:b], red[a:b], vi[a:b], when[a:b], p)] = np.nan
        cleaned = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, from_pandas=True))
        return pa.RecordBatch.from_arrays([*batch.columns[:-4], days, cleaned], names=[*batch.schema.names[:-3], "s_vi"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in [*keys, *more])
    return arrays.mapInArrow(in_parts(clean, SERIES), f"{kinds}, s_day array<date>, s_vi array<double>")


def despike(obs: DataFrame, p: Params = Params(), keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """``(keys, date, vi)`` with ``vi`` null at spikes: the rows of :func:`despiked_arrays`."""
    out = despiked_arrays(obs, p, keys, date)
    return out.select(*keys, F.inline(F.arrays_zip("s_day", "s_vi")).alias(date, "vi"))
