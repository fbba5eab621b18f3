"""Weighted cubic smoothing splines, evaluated on every slot of a year window."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_parts, offsets

CURVES = 256  # that are solved together


def knot_count(n: int) -> int:
    """All distinct points below 50; beyond, a number that grows with the logarithm of theirs."""
    if n < 50:
        return n
    steps = [(50, 50), (200, 100), (800, 140), (3200, 200)]  # fixed values: points and their knots
    for (n0, k0), (n1, k1) in zip(steps, steps[1:]):
        if n < n1:
            return int(2 ** (np.log2(k0) + (np.log2(k1) - np.log2(k0)) * (n - n0) / (n1 - n0)))
    return int(200 + (n - 3200) ** 0.2)


@lru_cache(maxsize=4096)
def _knot_places(n: int) -> np.ndarray:
    """Which of ``n`` distinct points are knots."""
    return np.linspace(0, n - 1, knot_count(n)).astype(int)


def _interval(x: np.ndarray, curve: np.ndarray, knots: np.ndarray, n_knots: np.ndarray) -> np.ndarray:
    """The knot before each ``x`` of a curve, from 0. ``knots`` has a row for each curve: three more at both ends, and infinity after the last."""
    n, wide = knots.shape
    # rows lie behind one another on one axis, so that one search serves all curves
    inner = np.where(np.arange(wide)[None] < (n_knots + 3)[:, None], knots, 2.0)[:, 3:] + 4.0 * np.arange(n)[:, None]
    i = np.searchsorted(inner.ravel(), x + 4.0 * curve, side="right") - 1 - curve * (wide - 3)
    return np.clip(i, 0, n_knots[curve] - 2)


def _basis(x: np.ndarray, curve: np.ndarray, knots: np.ndarray, n_knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the four cubic B-splines that are not zero at each ``x`` of a curve, and their values."""
    i = _interval(x, curve, knots, n_knots) + 3
    flat, at = knots.ravel(), curve * knots.shape[1] + i
    b = np.ones((len(x), 1))
    for k in range(1, 4):
        nxt = np.zeros((len(x), k + 1))
        for j in range(k):
            lo, hi = flat[at - k + 1 + j], flat[at + 1 + j]
            part = b[:, j] / (hi - lo)
            nxt[:, j] += part * (hi - x)
            nxt[:, j + 1] += part * (x - lo)
        b = nxt
    return i - 3, b


def _penalty(knots: np.ndarray, n_knots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integrals of products of second derivatives, as bands ``[curve, row, 0..3]``: the diagonal and three beside it.

    Also what three coefficients each give the second derivative at a knot, and the lengths between knots.
    """
    n, wide = knots.shape
    m = wide - 4  # coefficients of the longest curve
    row = np.arange(m)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap3 = 3 / (knots[:, 4 : m + 3] - knots[:, 1:m])  # first derivatives: of row i + 1 and i
        gap2 = 2 / (knots[:, 4 : m + 2] - knots[:, 2:m])
        second = np.stack([gap2 * gap3[:, :-1], -gap2 * (gap3[:, :-1] + gap3[:, 1:]), gap2 * gap3[:, 1:]], axis=2)
    used = np.arange(m - 2)[None] < n_knots[:, None]
    second = np.where(used[:, :, None], second, 0.0)
    h = np.where(np.arange(m - 3)[None] < (n_knots - 1)[:, None], np.diff(np.where(np.isfinite(knots), knots, 0.0)[:, 3 : m + 1], axis=1), 0.0)
    own = np.zeros((n, m - 2))
    own[:, :-1] += h / 3
    own[:, 1:] += h / 3
    out = np.zeros((n, m, 4))
    for i in range(3):
        for j in range(i, 3):
            out[:, row[i : m - 2 + i], j - i] += own * second[:, :, i] * second[:, :, j]
    for i in range(3):  # products of neighbours, whose rows are one apart
        for j in range(3):
            lo, hi = min(i, j + 1), max(i, j + 1)
            part = h / 6 * second[:, :-1, i] * second[:, 1:, j]
            out[:, row[lo : m - 3 + lo], hi - lo] += part * (2 if lo == hi else 1)
    return out, second, h


def _solved(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric banded systems, one for each curve, by Cholesky; all curves go through a row together."""
    low, y = bands.transpose(1, 2, 0).copy(), right.T.copy()
    m = len(low)
    for r in range(m):
        low[r, 0] = np.sqrt(low[r, 0])
        low[r, 1:] /= low[r, 0]
        y[r] /= low[r, 0]
        for a in range(1, min(4, m - r)):
            low[r + a, : 4 - a] -= low[r, a] * low[r, a:]
            y[r + a] -= low[r, a] * y[r]
    for r in range(m - 1, -1, -1):
        for a in range(1, min(4, m - r)):
            y[r] -= low[r, a] * y[r + a]
        y[r] /= low[r, 0]
    return y.T


def smoothing_splines(curve: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, at: np.ndarray, spar: float = 0.55) -> np.ndarray:
    """A row on ``at`` for each of ``n`` curves; ``curve`` says which one a point ``(x, y, w)`` is of.

    A curve minimises the weighted squares plus ``lambda`` times the integral of the squared second
    derivative. Points with equal ``x`` are merged; x is scaled to 0..1 and weights to a sum of their
    number. ``lambda`` is the ratio of the traces of the two matrices (the outermost rows left out:
    two at the start, three at the end) times ``256 ** (3 spar - 1)``. Outside the data the curve is
    straight. Fewer than four distinct points with a weight give NaN.

    Both matrices have three bands beside the diagonal. Those of all curves are made and solved at
    once, in arrays; shorter curves end in rows of the unit matrix.
    """
    out = np.full((n, len(at)), np.nan)
    good = np.isfinite(x) & np.isfinite(y) & (w > 0)
    order = np.lexsort((x[good], curve[good]))
    c, x, y, w = (v[good][order] for v in (curve, x, y, w))
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (x[1:] != x[:-1])])[: len(c)])
    if not len(first):
        return out
    sw = np.add.reduceat(w, first)
    uy, c, x = np.add.reduceat(w * y, first) / sw, c[first], x[first]
    enough = np.flatnonzero(np.bincount(c, minlength=n) >= 4)
    if not len(enough):
        return out
    keep = np.isin(c, enough)
    c, x, uy, sw = np.searchsorted(enough, c[keep]), x[keep], uy[keep], sw[keep]
    size = np.bincount(c)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    sw *= size[c] / np.bincount(c, weights=sw)[c]
    low, span = x[start], x[start + size - 1] - x[start]
    u = (x - low[c]) / span[c]

    n_knots = np.array([len(_knot_places(k)) for k in size.tolist()])
    wide = int(n_knots.max()) + 6
    knots = np.full((len(size), wide), np.inf)
    for i, (a, k) in enumerate(zip(start.tolist(), size.tolist())):
        inner = u[a + _knot_places(k)]
        knots[i, : len(inner) + 6] = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])

    m = wide - 4
    f, b = _basis(u, c, knots, n_knots)
    gram = np.zeros((len(size), m, 4))
    right = np.zeros((len(size), m))
    for i in range(4):
        right += np.bincount(c * m + f + i, weights=b[:, i] * sw * uy, minlength=right.size).reshape(right.shape)
        for j in range(i, 4):
            gram[:, :, j - i] += np.bincount(c * m + f + i, weights=b[:, i] * b[:, j] * sw, minlength=right.size).reshape(right.shape)
    penalty, second, h = _penalty(knots, n_knots)
    own = np.arange(m)[None] < (n_knots + 2)[:, None]
    middle = (np.arange(m)[None] >= 2) & (np.arange(m)[None] < (n_knots - 1)[:, None])
    ratio = np.where(middle, gram[:, :, 0], 0).sum(axis=1) / np.where(middle, penalty[:, :, 0], 0).sum(axis=1)
    bands = gram + (ratio * 256 ** (3 * spar - 1))[:, None, None] * penalty
    bands[:, :, 0] = np.where(own, bands[:, :, 0], 1.0)
    coef = _solved(bands, right)

    # values and second derivatives at the knots say the cubics between them
    bend = sum(second[:, :, i] * coef[:, i : m - 2 + i] for i in range(3))
    where = np.arange(m - 2)[None] < n_knots[:, None]
    each, of = np.nonzero(where)
    f, b = _basis(knots[each, of + 3], each, knots, n_knots)
    level = np.zeros((len(size), m - 2))
    level[where] = sum(b[:, i] * coef[each, f + i] for i in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (level[:, 1:] - level[:, :-1]) / h - h * (2 * bend[:, :-1] + bend[:, 1:]) / 6
        third = (bend[:, 1:] - bend[:, :-1]) / h / 6
    v = (at[None] - low[:, None]) / span[:, None]
    inside, rows = np.clip(v, 0, 1).ravel(), np.repeat(np.arange(len(size)), len(at))
    i = _interval(inside, rows, knots, n_knots)
    flat = rows * (m - 3) + i
    d = inside - knots.ravel()[rows * wide + i + 3]
    value = (level[:, :-1].ravel()[flat] + d * (slope.ravel()[flat] + d * (bend[:, :-1].ravel()[flat] / 2 + d * third.ravel()[flat]))).reshape(v.shape)
    last, each = n_knots + 1, np.arange(len(size))
    slope0 = 3 * (coef[:, 1] - coef[:, 0]) / (knots[:, 4] - knots[:, 1])
    slope1 = 3 * (coef[each, last] - coef[each, last - 1]) / (knots[each, last + 3] - knots[each, last])
    out[enough] = value + np.where(v < 0, v * slope0[:, None], 0) + np.where(v > 1, (v - 1) * slope1[:, None], 0)
    return out


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, spar: float = 0.55) -> np.ndarray | None:
    """:func:`smoothing_splines` for one curve; None where it can't be fitted."""
    out = smoothing_splines(np.zeros(len(x), int), x, y, w, 1, at, spar)[0]
    return None if np.isnan(out).all() else out


def smooth(points: DataFrame, keys: list[str], slots: int = 735, spar: float = 0.55) -> DataFrame:
    """``(keys, curve)``: each row's spline on slots 1 to ``slots``, raised to ``dormant`` where below.

    ``points`` has a row for each curve with the arrays ``xs``, ``ys`` and ``ws`` and the column
    ``dormant``; a curve is null if the spline can't be fitted.
    """
    at = np.arange(1, slots + 1, dtype=float)

    def floats(column: pa.Array) -> np.ndarray:
        return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs, ys, ws = (batch.column(c) for c in ("xs", "ys", "ws"))
        curve = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(xs), 0).to_numpy())
        out = smoothing_splines(curve, floats(xs.flatten()), floats(ys.flatten()), floats(ws.flatten()), batch.num_rows, at, spar)
        low = floats(batch.column("dormant"))[:, None]
        out = np.where(out < low, low, out)
        known = np.isfinite(out).all(axis=1)
        lists = pa.ListArray.from_arrays(offsets(np.where(known, slots, 0)), out[known].ravel(), mask=pa.array(~known))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), lists], names=[*keys, "curve"])

    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.select(*keys, "xs", "ys", "ws", "dormant").mapInArrow(in_parts(work, CURVES), f"{kinds}, curve array<double>")


def gathered(rows: DataFrame, keys: list[str], x: str = "day_idx", y: str = "vi", w: str | None = None) -> DataFrame:
    """Rows to the arrays of :func:`smooth`, in order of ``x``; a group is one curve's points."""
    weight = F.lit(1.0) if w is None else F.col(w)
    one = F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y"), weight.alias("w"))
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("p"), F.first("dormant").alias("dormant"))
    return out.select(*keys, "dormant", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.w").alias("ws"))
