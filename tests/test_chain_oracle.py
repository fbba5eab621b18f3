"""The whole chain against a plain version of it: one cell after the other, by the rules as stated, with a spline solver of its own."""

import datetime as dt
import math
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.operators.spline import smoothing_spline, smoothing_splines
from leafline.plans import fixtures as X
from leafline.plans import phenology as P
from leafline.plans.fixtures import PARAMS
from leafline.plans.params import LAYER_NAMES

DAY = dt.timedelta(days=1)


# A spline from the recursion of B-splines and an integral by Gauss points.


def _b(t, j, k, x):
    if k == 0:
        last = t[j + 1] == t[-1] and t[j] < t[j + 1]
        return ((x >= t[j]) & ((x < t[j + 1]) | (last & (x <= t[j + 1])))).astype(float)
    out = np.zeros(len(x))
    if t[j + k] > t[j]:
        out += (x - t[j]) / (t[j + k] - t[j]) * _b(t, j, k - 1, x)
    if t[j + k + 1] > t[j + 1]:
        out += (t[j + k + 1] - x) / (t[j + k + 1] - t[j + 1]) * _b(t, j + 1, k - 1, x)
    return out


def _derived(t, j, k, times, x):
    if times == 0:
        return _b(t, j, k, x)
    out = np.zeros(len(x))
    if t[j + k] > t[j]:
        out += k / (t[j + k] - t[j]) * _derived(t, j, k - 1, times - 1, x)
    if t[j + k + 1] > t[j + 1]:
        out -= k / (t[j + k + 1] - t[j + 1]) * _derived(t, j + 1, k - 1, times - 1, x)
    return out


def plain_spline(xs, ys, ws, at, spar=0.55):
    merged = {}
    for x, y, w in zip(xs, ys, ws):
        sw, sy = merged.get(x, (0.0, 0.0))
        merged[x] = (sw + w, sy + w * y)
    ux = sorted(merged)
    if len(ux) < 4:
        return None
    n = len(ux)
    w = np.array([merged[x][0] for x in ux])
    y = np.array([merged[x][1] / merged[x][0] for x in ux])
    w = w * n / w.sum()
    u = (np.array(ux, float) - ux[0]) / (ux[-1] - ux[0])
    knots = n if n < 50 else int(2 ** (math.log2(50) + (n - 50) / 150)) if n < 200 else int(2 ** (math.log2(100) + math.log2(1.4) * (n - 200) / 600))
    inner = [u[int((n - 1) * i / (knots - 1))] for i in range(knots)]
    t = np.array([inner[0]] * 3 + inner + [inner[-1]] * 3)
    m = len(t) - 4
    design = np.stack([_b(t, j, 3, u) for j in range(m)], axis=1)
    lo, hi = np.array(inner[:-1]), np.array(inner[1:])
    where = np.concatenate([(lo + hi) / 2 + s * (hi - lo) / (2 * math.sqrt(3)) for s in (-1, 1)])
    weight = np.concatenate([(hi - lo) / 2] * 2)
    bent = np.stack([_derived(t, j, 3, 2, where) for j in range(m)], axis=1)
    gram, penalty = design.T @ (w[:, None] * design), bent.T @ (weight[:, None] * bent)
    own = range(2, m - 3)
    ratio = sum(gram[i, i] for i in own) / sum(penalty[i, i] for i in own)
    c = np.linalg.solve(gram + ratio * 256 ** (3 * spar - 1) * penalty, design.T @ (w * y))
    v = (np.array(at, float) - ux[0]) / (ux[-1] - ux[0])
    ends, slopes = (np.stack([f(j, np.array([0.0, 1.0])) for j in range(m)], axis=1) @ c for f in (lambda j, x: _b(t, j, 3, x), lambda j, x: _derived(t, j, 3, 1, x)))
    inside = np.stack([_b(t, j, 3, np.clip(v, 0, 1)) for j in range(m)], axis=1) @ c
    return np.where(v < 0, ends[0] + v * slopes[0], np.where(v > 1, ends[1] + (v - 1) * slopes[1], inside))


def test_spline_equals_an_independent_solver():
    rng = np.random.default_rng(5)
    for n in (4, 9, 49, 50, 120, 260):
        x = np.sort(rng.choice(np.arange(20, 700), n, replace=False)).astype(float)
        x = np.concatenate([x, x[:2]])
        y, w = np.sin(x / 60) + rng.normal(0, 0.1, len(x)), rng.uniform(0.1, 1, len(x))
        at = np.arange(1.0, 736)
        assert np.allclose(smoothing_spline(x, y, w, at), plain_spline(x, y, w, at), atol=1e-6)


def test_curves_solved_together_equal_single_ones():
    """Curves of 2 to 735 points, some weights zero, repeated days, in any order of points."""
    rng = np.random.default_rng(4)
    at = np.arange(1, 736, dtype=float)
    own = []
    for n in [2, 3, 4, 5, 7, 20, 49, 50, 90, 200, 735, *rng.integers(4, 150, 60)]:
        x = np.sort(rng.choice(735, n, replace=False) + 1.0)
        x = np.concatenate([x, x[: n % 3]])
        own.append((x, rng.random(len(x)), np.where(rng.random(len(x)) < 0.1, 0.0, rng.choice([0.3, 1.0], len(x)))))
    curve = np.repeat(np.arange(len(own)), [len(x) for x, _, _ in own])
    mixed = rng.permutation(len(curve))
    got = smoothing_splines(curve[mixed], *(np.concatenate(c)[mixed] for c in zip(*own)), len(own), at)
    for (x, y, w), out in zip(own, got):
        if len(np.unique(x[w > 0])) < 4:
            assert np.isnan(out).all()
        else:
            assert np.allclose(out, plain_spline(x[w > 0], y[w > 0], w[w > 0], at), atol=1e-6)
    assert np.isnan(smoothing_splines(np.empty(0, int), np.empty(0), np.empty(0), np.empty(0), 2, at)).all()



# The chain.


def despiked(rows, p):
    """``rows`` are (date, blue, red, vi); the dates of spikes."""
    spikes = set()
    for _ in range(p.max_despike_passes):
        r = [x for x in rows if None not in x[1:] and x[0] not in spikes]
        inner = list(zip(r, r[1:], r[2:]))
        if not inner:
            break
        bends = [(b[3] - a[3]) - (c[3] - b[3]) for a, b, c in inner]
        mid = median(bends)
        reach = p.mad_factor * median(abs(b[3] - mid) for _, b, _ in inner) / 0.6745
        new = set()
        for (a, b, c), bend in zip(inner, bends):
            before, after = (b[0] - a[0]).days, (c[0] - b[0]).days
            cloud = all(b[1] - o[1] > 0.03 * (1 + days / 30) and b[2] - o[2] < 1.5 * (b[1] - o[1]) for o, days in ((a, before), (c, after)))
            below = a[3] + (c[3] - a[3]) * (before / (before + after)) - b[3]
            dip = below > p.min_residual and abs(below) > p.spike_ratio * abs(c[3] - a[3]) and before + after < p.max_distance
            if cloud or dip or abs(bend - mid) > reach:
                new.add(b[0])
        if not new:
            break
        spikes |= new
    return spikes


def cycles_of(x, p):
    """Start, peak and end, from 0, of the cycles of a curve."""
    tops = []
    i = 0
    while i < len(x) - 1:
        j = i + 1
        while j < len(x) - 1 and x[j + 1] == x[j]:
            j += 1
        if x[j] > x[i] and j < len(x) - 1 and x[j + 1] < x[j]:
            tops.append(i + 1 + round((j - i - 1) / 2))
        i = j
    year = x[p.spline_buffer : p.spline_buffer + 365]
    least = max(p.min_seg_amplitude, p.rel_amp_frac * (max(year) - min(year)))
    alive, out = set(tops), []
    for top in sorted(tops, key=lambda k: x[k]):
        a = max([0, top - p.max_increase, *(k for k in alive if k < top)])
        b = min([len(x) - 1, top + p.max_decrease, *(k for k in alive if k > top)])
        start = max(k for k in range(a, top + 1) if x[k] == min(x[a : top + 1]))
        end = min(k for k in range(top, b + 1) if x[k] == min(x[top : b + 1]))
        if x[top] >= 0 and x[top] - x[start] >= least and x[top] - x[end] >= least:
            out.append((start, top, end))
        else:
            alive.discard(top)
    return out


def limb(days, values, curve, a, b):
    """Fit, number and longest gap of the observations in slots a to b, from 0."""
    seen = [(d - 1, v) for d, v in zip(days, values) if a <= d - 1 <= b]
    if not seen:
        return None, 0, None
    mean = sum(v for _, v in seen) / len(seen)
    spread = sum((v - mean) ** 2 for _, v in seen)
    fit = 1 - sum((v - curve[d]) ** 2 for d, v in seen) / spread if spread else None
    stops = [a, *(d for d, _ in seen), b]
    return fit, len(seen), max(q - r for q, r in zip(stops[1:], stops))


def weak(low, hi, amp, occ, p):
    if not (0 <= hi <= 1 and 0 <= amp <= 1):
        return True
    return low < p.dormant_low and (amp < p.weak_high and occ > p.water_high or amp < p.weak_low and occ > p.water_low)


def layers(year, curve, days, values, low, occ, n_obs, p):
    nothing = {n: None for n in LAYER_NAMES} | {"QA": 4, "QA_2": 4}
    if curve is None:
        return nothing
    buffer = p.spline_buffer
    own = [c for c in cycles_of(curve, p) if buffer <= c[1] < buffer + 365]
    length = 366 if year % 4 == 0 else 365
    if not own:
        inside = curve[buffer : buffer + length]
        hi, amp = max(inside), max(inside) - min(inside)
        if weak(low, hi, amp, occ, p):
            return nothing
        n = sum(buffer < d <= buffer + length for d in days)
        return nothing | {"NumCycles": 0, "EVImax": hi * 10000, "EVIamp": amp * 10000, "EVIarea": sum(inside) * 100, "numObs": n}
    told = []
    for a, top, b in own:
        up = [next(k for k in range(a, top + 1) if round(curve[k], 6) >= round(curve[a] + (curve[top] - curve[a]) * s, 6)) for s in p.green_up]
        down = [next(k for k in range(b, top - 1, -1) if round(curve[k], 6) >= round(curve[b] + (curve[top] - curve[b]) * s, 6)) for s in p.green_down]
        dates = [k + 1 - buffer for k in (*up, top, *down)]
        (r1, n1, g1), (r2, n2, g2) = limb(days, values, curve, a, top), limb(days, values, curve, top, b)
        if n1 == 0 or n2 == 0:
            told.append((None, top, dates, None, None, None))
            continue
        part = curve[a : b + 1]
        qa = None
        if r1 is not None and r2 is not None:
            qa = 3 - (min(r1, r2) >= p.qa_r2) - (max(g1, g2) <= p.qa_gap)
        told.append((max(part) - min(part), top, dates, max(part), sum(part), qa))
    told.sort(key=lambda c: (c[0] is None, -(c[0] or 0), c[1]))
    if any(c[5] is None for c in told[:2]) or weak(low, told[0][3], told[0][0], occ, p):
        return nothing
    out = dict(nothing) | {"NumCycles": sum(c[0] is not None for c in told), "numObs": n_obs}
    for k, (amp, _, dates, hi, area, qa) in enumerate(told[:2]):
        out.update(zip(LAYER_NAMES[1 + 11 * k : 12 + 11 * k], [*dates, hi * 10000, amp * 10000, area * 100, qa]))
    return out


def plain_chain(rows, occ, p):
    """A dictionary of layers for each year of one cell; ``rows`` are (date, blue, red, vi) in order."""
    valid = [r[3] for r in rows if r[3] is not None]
    water = sum(v < 0 for v in valid) / len(valid) > p.negative_share and occ > p.water_low
    spikes = despiked(rows, p)
    vi = {r[0]: r[3] for r in rows if r[3] is not None and r[0] not in spikes}
    bounds = [dt.date.fromisoformat(d) for d in (p.dormant_from, p.dormant_to)]
    low = float(np.quantile([v for d, v in vi.items() if v > 0 and bounds[0] <= d <= bounds[1]], p.dormant_quantile))
    vi = {d: max(v, low) for d, v in vi.items()}
    starts = {y: dt.date(y, 1, 1) - p.spline_buffer * DAY for y in p.years}
    if p.composite_days:
        bins = {}
        for d, v in vi.items():
            k = (d - min(starts.values())).days
            if 0 <= k and d < max(starts.values()) + p.slots * DAY:
                bins.setdefault(k // p.composite_days, []).append(v)
        vi = {min(starts.values()) + (k * p.composite_days + p.composite_days // 2) * DAY: max(v) for k, v in sorted(bins.items())}
    known = sorted(vi)
    gap = {a + k * DAY for a, b in zip(known, known[1:]) if (b - a).days > p.gap_days for k in range((b - a).days)}
    at = list(range(1, p.slots + 1))
    seen = {y: [(k, vi[d]) for d in known if 1 <= (k := (d - s).days + 1) <= p.slots] for y, s in starts.items()}
    first, masked = {}, {}
    for y, s in starts.items():
        c = plain_spline([k for k, _ in seen[y]], [v for _, v in seen[y]], [1.0] * len(seen[y]), at, p.spar) if seen[y] else None
        first[y] = None if c is None else [max(v, low) for v in c.tolist()]
        if c is not None:
            ends = seen[y][0][0], seen[y][-1][0]
            masked[y] = {k: v for k, v in zip(at, first[y]) if ends[0] <= k <= ends[1] and (d := s + (k - 1) * DAY).year == y and d not in gap}

    def like(y, other):
        a, b = masked.get(y), masked.get(other)
        if not a or not b:
            return 0.0
        mean, both = sum(a.values()) / len(a), a.keys() & b.keys()
        flat = math.sqrt(sum((mean - a[k]) ** 2 for k in both))
        if len(both) < p.min_common_days or flat == 0:
            return 0.0
        return p.max_weight * max(0.0, 1 - math.sqrt(sum((b[k] - a[k]) ** 2 for k in both)) / flat)

    out = {}
    for y, s in starts.items():
        curve = first[y]
        if any(s + (k - 1) * DAY in gap for k in at):
            points = [(k, v, 1.0) for k, v in seen[y]]
            for other in p.years:
                for k, v in seen[other] if other != y else ():
                    side = max(y - 1, min(p.years)) if k <= p.spline_buffer else min(y + 1, max(p.years)) if k > p.spline_buffer + 365 else y
                    w = like(side, other) if s + (k - 1) * DAY in gap else 0.0
                    if w > 0:
                        points.append((k, v, w))
            c = plain_spline(*zip(*points), at, p.spar) if points else None
            curve = None if c is None else [max(v, low) for v in c.tolist()]
        days, values = [k for k, _ in seen[y]], [v for _, v in seen[y]]
        n_obs = sum(p.spline_buffer < k <= p.spline_buffer + 365 for k in days)
        out[y] = layers(y, None if water else curve, days, values, low, occ, n_obs, p)
    return out


@pytest.mark.parametrize("composite", [0, 3])
def test_chain_equals_a_plain_version(spark, small, composite):
    """All 24 layers of every cell and year; every third cell is thinned, so that windows have gaps and years without cycles."""
    from dataclasses import replace

    p = replace(PARAMS, composite_days=composite)
    s = X.series(spark, small).where((F.col("cell") % 3 != 0) | (F.dayofyear("obs_date") > 70) & (F.xxhash64("obs_date") % 4 == 0) | (F.month("obs_date") == 7))
    s = s.cache()
    got = {(r["cell"], r["year"]): r.asDict() for r in P.phenology(s, X.water(spark, small), p).collect()}
    occ = {r["cell"]: r["occ"] for r in X.water(spark, small).collect()}
    cells = {}
    for r in s.orderBy("cell", "obs_date").collect():
        cells.setdefault(r["cell"], []).append((r["obs_date"], r["blue"], r["red"], r["vi"]))
    kinds = set()
    for cell, rows in cells.items():
        for year, want in plain_chain(rows, occ[cell], p).items():
            own = got[cell, year]
            kinds.add(want["NumCycles"])
            for name in LAYER_NAMES:
                a, b = own[name], want[name]
                assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-3)), (cell, year, name, a, b)
    assert len(got) == 5 * len(cells) and len(kinds) > 1
    s.unpersist()
