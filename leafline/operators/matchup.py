"""Points against cells and dates against dates: buffers, extents, nearest events, agreement."""

from __future__ import annotations

from math import ceil, exp, floor, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import date_from_doy, doy_across_years, shift_point
from ..sources.tables import scratch_path
from .geometry import SMALL_CROWD, box_of, crowds_in_polygons, in_edges, in_polygon, points_in_boxes


def point_in_extent(points: DataFrame, extents: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points with each extent ``(x0, x1, y0, y1)`` that holds them, whatever the extents' sizes."""
    return points_in_boxes(points, extents, x, y)


def point_in_tile(points: DataFrame, tiles: DataFrame, point_id: str = "point_id", crowd: int = SMALL_CROWD) -> DataFrame:
    """Each point's first tile by name; tiles have a ``name`` and ``rings``: a polygon that may have holes and parts.

    Points are dealt to crowds, by cells of a quadtree. The first tile that holds a whole crowd rules
    out all later ones there, so a point is tested against those few that come before it and whose
    border touches the crowd, however many tiles lie over one another.
    """
    own = {"_bx0": F.col("x"), "_bx1": F.col("x"), "_by0": F.col("y"), "_by1": F.col("y"), "_proper": F.lit(True)}
    named, met = crowds_in_polygons(points.select(point_id, "x", "y").withColumns(own), tiles.select("name", "rings"), crowd=crowd)
    at = ["_at", "_salt"]
    best = met.where("whole").groupBy(*at).agg(F.min("name").alias("_best"))
    before = met.where("not whole").join(best, at, "left").where("_best is null or name < _best")
    some = before.select(*at, "name", "whole", "edges", "x0", "x1", "y0", "y1")
    all_ = some.unionByName(best.select(*at, F.col("_best").alias("name"), F.lit(True).alias("whole")), allowMissingColumns=True)
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")) & in_edges(F.col("x"), F.col("y"), F.col("edges"))
    near = named.join(all_, at).where(F.col("whole") | inside)
    return near.groupBy(point_id).agg(F.min("name").alias("tile"))


def buffer_pairs(points: DataFrame, cells: DataFrame, radius: float, keys: list[str], px: str = "x", py: str = "y") -> DataFrame:
    """Points with every cell within ``radius``: an equi-join on squares of that side, then the exact distance.

    ``cells`` has ``cx`` and ``cy``; ``keys`` are equal on both sides.
    """
    square = [F.floor(F.col(c) / radius) for c in (px, py)]
    around = F.explode(F.array(*(F.struct((square[0] + i).alias("bx"), (square[1] + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    p = points.withColumn("_b", around).withColumns({"bx": F.col("_b.bx"), "by": F.col("_b.by")}).drop("_b")
    c = cells.withColumns({"bx": F.floor(F.col("cx") / radius), "by": F.floor(F.col("cy") / radius)})
    dx, dy = F.col(px) - F.col("cx"), F.col(py) - F.col("cy")
    return p.join(c, [*keys, "bx", "by"]).where(dx * dx + dy * dy <= radius * radius).drop("bx", "by")


def buffer_extract(points: DataFrame, cells: DataFrame, radius: float, value: str, keys: list[str], by: list[str]) -> DataFrame:
    """Rounded (half to even) median and mean of the cells around each point, and their number."""
    pairs = buffer_pairs(points, cells, radius, keys)
    return pairs.groupBy(*by).agg(
        F.bround(F.median(value)).alias("median_value"), F.bround(F.avg(value)).alias("mean_value"), F.count(value).alias("n_cells")
    )


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_date: str, right_date: str, days: int = 100) -> DataFrame:
    """Left rows with the nearest right date less than ``days`` away, the earlier of two; others are left out.

    A key's dates are gathered by blocks of ``days``, each with those of its neighbours, so a row meets one
    array of at most three blocks' distinct dates. Left rows are neither multiplied nor grouped.
    """
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    a = left.withColumn("_block", block(F.col(left_date)))
    b = right.select(*keys, right_date, F.explode(F.array(*(block(F.col(right_date)) + i for i in (-1, 0, 1)))).alias("_block"))
    b = b.groupBy(*keys, "_block").agg(F.collect_set(right_date).alias("_dates"))
    apart = lambda e: F.abs(F.datediff(left_date, e)).alias("days_apart")
    best = F.array_min(F.transform("_dates", lambda e: F.struct(apart(e), e.alias("nearest"))))
    pairs = a.join(b, [*keys, "_block"]).withColumn("_m", best).where(F.col("_m.days_apart") < days)
    return pairs.select(*left.columns, "_m.nearest", "_m.days_apart")


def agreement(pairs: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """``n``, correlation, root mean square difference and bias (mean of x - y) over complete pairs."""
    d = F.col(x) - F.col(y)
    full = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"),
    )


def density_2d(pairs: DataFrame, x: str, y: str, x0: float, x1: float, y0: float, y1: float, bins: int = 850) -> DataFrame:
    """``(bx, by, n)``: counts of pairs in a square grid of bins; the outer edge belongs to the last bin."""
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("long")
    inside = pairs.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(at(x, x0, x1).alias("bx"), at(y, y0, y1).alias("by")).agg(F.count("*").alias("n"))


def bandwidth(c: str, share: float = 25.0) -> Column:
    """The width of a smoothing kernel: the span of the middle nine tenths of the values, divided by ``share``."""
    return (F.percentile(c, F.lit(0.95)) - F.percentile(c, F.lit(0.05))) / F.lit(share)


def percentiles(rows: DataFrame, c: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a column, as :func:`pyspark.sql.functions.percentile` has them; none for no value.

    Counts of distinct values are dealt out by ranges of values, and a range's places go on where
    those before it end, so no task holds more than its range. The ranges are written to the shared
    folder first, as their bounds come from a sample and must stay the same.
    """
    path = scratch_path(rows.sparkSession, "value-ranges")
    each = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(F.count("*").alias("n"))
    each.repartitionByRange("v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    each = rows.sparkSession.read.parquet(path)
    sizes = each.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.orderBy("part")) - F.col("all")  # a row for each range
    placed = each.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    last = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    total = sizes.agg(F.sum("all")).first()[0] or 0
    if not total:
        return [None] * len(shares)
    at = [(total - 1) * s for s in shares]
    wanted = sorted({f(a) for a in at for f in (floor, ceil)})
    holds = [F.first(F.when((F.lit(w) >= F.col("last") - F.col("n")) & (F.lit(w) < F.col("last")), F.col("v")), True) for w in wanted]
    value = dict(zip(wanted, placed.withColumn("last", last).agg(*holds).first()))
    return [value[floor(a)] if floor(a) == ceil(a) else (ceil(a) - a) * value[floor(a)] + (a - floor(a)) * value[ceil(a)] for a in at]


def bandwidths(rows: DataFrame, cols: list[str], share: float = 25.0) -> list[float | None]:
    """:func:`bandwidth` of columns with any number of distinct values: an aggregate would hold them all in one task."""
    ends = [percentiles(rows, c, [0.05, 0.95]) for c in cols]
    return [None if low is None else (high - low) / share for low, high in ends]


def smoothed_density(counts: DataFrame, wx: float, wy: float, hx: float, hy: float, bins: int = 850, reach: float = 3.4) -> DataFrame:
    """``(bx, by, density)`` of the bins of :func:`density_2d`, which are ``wx`` by ``wy``: smoothed by normal kernels of widths ``hx`` and ``hy``.

    A kernel ends at ``reach`` widths, and at the grid's edge. As it is a product, the bins are shifted and
    summed along one axis and then along the other; rows stay as many as bins that get anything.
    """
    total = counts.agg(F.sum("n")).first()[0]

    def along(df: DataFrame, axis: str, width: float, h: float) -> DataFrame:
        r = min(int(reach * h / width), bins - 1)
        weight = [exp(-0.5 * (k * width / h) ** 2) / (h * sqrt(2 * pi)) for k in range(-r, r + 1)]
        shifts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-r, r + 1), weight)))).alias("s")
        other = "by" if axis == "bx" else "bx"
        moved = df.select(axis, other, "v", shifts).select((F.col(axis) + F.col("s.k")).alias(axis), other, (F.col("v") * F.col("s.w")).alias("v"))
        return moved.where(F.col(axis).between(0, bins - 1)).groupBy("bx", "by").agg(F.sum("v").alias("v"))

    start = counts.select("bx", "by", (F.col("n") / F.lit(float(total or 1))).alias("v"))
    return along(along(start, "bx", wx, hx), "by", wy, hy).withColumnRenamed("v", "density")


def _drawn(*of: Column | str) -> Column:
    """Hex digits that depend on all the values, and look random."""
    return F.md5(F.concat_ws("|", *of))


def sample_n(rows: DataFrame, n: int, key: str | list[str], seed: int, by: list[str] | None = None) -> DataFrame:
    """``n`` rows without replacement, of each group of ``by`` if given: the first by a seeded hash of the key.

    So the sample is the same for any partitioning.
    """
    keys = [key] if isinstance(key, str) else key
    order = [_drawn(*keys, F.lit(seed)), *keys]
    if not by:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def random_points(extents: DataFrame, n: int, seed: int, key: str = "site") -> DataFrame:
    """``n`` uniform points in each extent, numbered from 0; they depend on the extent's key and the seed."""
    each = extents.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    unit = lambda k: F.conv(F.substring(_drawn(key, "point", F.lit(seed + k)), 1, 7), 16, 10).cast("long") / float(1 << 28)
    return each.select(
        *extents.columns, "point",
        (F.col("x0") + unit(0) * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + unit(1) * (F.col("y1") - F.col("y0"))).alias("y"),
    )


def series_overlay(series: DataFrame, station: DataFrame, on: list[str]) -> DataFrame:
    """A cell's series beside a station's, on all dates of either."""
    return series.join(station, on, "full")


def station_matchup(
    stations: DataFrame, extents: DataFrame, cells: DataFrame, dates: DataFrame, by: list[str], radius: float = 7.5, days: int = 100, shift: float = 30.0
) -> DataFrame:
    """``(by, direction, n, r, rmse, bias)``: transition dates of stations against the product around them.

    ``stations`` has ``station``, ``x``, ``y`` and the columns ``by``; ``extents`` a ``site`` each; ``cells``
    ``(site, cx, cy, year, direction, value)`` with days of the year; ``dates`` ``(station, direction, seen)``.
    A station inside a site's extent, moved north by ``shift``, gets the rounded median of the cells around
    it for each year; that date meets the station's nearest one less than ``days`` away, and the days of
    the year are compared, those across a turn of the year corrected.
    """
    inside = point_in_extent(stations, extents).withColumn("y", shift_point("y", shift))
    # stations at the same places share what is around them
    at = F.sort_array(F.collect_list(F.struct("x", "y"))).alias("places")
    inside = inside.groupBy("station", *by, "site").agg(at)
    places = inside.select("site", "places").distinct().withColumn("p", F.explode("places")).select("site", "places", "p.x", "p.y")
    around = buffer_extract(places, cells, radius, "value", ["site"], ["site", "places", "year", "direction"]).where("median_value is not null")
    around = around.select("site", "places", "year", "direction", date_from_doy("year", "median_value").alias("told"))
    told = inside.join(around, ["site", "places"]).select("station", *by, "site", "year", "direction", "told")
    near = nearest_within(told, dates.select("station", "direction", "seen"), ["station", "direction"], "told", "seen", days)
    pairs = near.select(*by, "direction", doy_across_years("nearest", F.year("told")).alias("a"), F.dayofyear("told").alias("b"))
    return agreement(pairs, "a", "b", [*by, "direction"])


def grid_matchup(
    extents: DataFrame, tiles: DataFrame, fine: DataFrame, coarse: DataFrame, n: int = 3000, radius: float = 45.0, sample: int = 100_000, seed: int = 11
) -> DataFrame:
    """``(layer, stat, n, r, rmse, bias)``: two products around random points of each site.

    ``fine`` has ``(site, cx, cy, layer, value)``, ``coarse`` ``(tile, cx, cy, layer, value)``. ``n`` points are
    drawn in each site's extent; a site's tile is the first by name that holds any of them. The rounded
    medians and means of both products within ``radius`` make a pair where both are known; of each
    layer's pairs ``sample`` are compared, medians and means apart.
    """
    points = random_points(extents, n, seed).select("site", "point", "x", "y")
    boxed = tiles.select("name", "rings").withColumns(box_of(F.col("rings")))
    held = point_in_extent(points, boxed).where(in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    first = held.groupBy("site").agg(F.min("name").alias("tile"))
    own = ["site", "point", "layer"]
    a = buffer_extract(points, fine, radius, "value", ["site"], own)
    b = buffer_extract(points.join(first, "site"), coarse, radius, "value", ["tile"], own)
    both = a.select(*own, F.col("median_value").alias("ma"), F.col("mean_value").alias("aa")).join(
        b.select(*own, F.col("median_value").alias("mb"), F.col("mean_value").alias("ab")), own
    )
    picked = sample_n(both.dropna(), sample, ["site", "point"], seed, ["layer"])
    stats = picked.select("layer", F.expr("stack(2, 'median', ma, mb, 'mean', aa, ab) as (stat, a, b)"))
    return agreement(stats, "a", "b", ["layer", "stat"])
