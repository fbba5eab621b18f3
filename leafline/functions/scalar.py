"""Column expressions: reflectance, indexes, dates, names, grid cells and projections."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.params import VEG_CLASSES


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_reflectance(c: str | Column, scale: float = 10000.0) -> Column:
    """Stored integers to reflectance."""
    return _c(c) / F.lit(scale)


def evi2(nir: str | Column, red: str | Column) -> Column:
    """The two-band enhanced vegetation index; null where its denominator is zero."""
    nir, red = _c(nir), _c(red)
    return F.try_divide(F.lit(2.5) * (nir - red), nir + F.lit(2.4) * red + F.lit(1.0))


def floor_at(c: str | Column, floor: str | Column) -> Column:
    """Values below ``floor`` are raised to it; null values stay null, a null floor raises nothing."""
    c, floor = _c(c), _c(floor)
    return F.when(c < floor, floor).otherwise(c)


def in_year(slot: str | Column, buffer: int = 185) -> Column:
    return (_c(slot) > buffer) & (_c(slot) <= buffer + 365)


def prev_year(slot: str | Column, buffer: int = 185) -> Column:
    return _c(slot) <= buffer


def next_year(slot: str | Column, buffer: int = 185) -> Column:
    return _c(slot) > buffer + 365


def pack_layer(value: str | Column, valid_min: str | Column, valid_max: str | Column, fill: str | Column) -> Column:
    """Values within the valid range, cut to whole numbers as a short; anything else becomes the fill value."""
    v = _c(value)
    return F.when(v.between(_c(valid_min), _c(valid_max)), v).otherwise(_c(fill)).cast("int").cast("short")


def unpack_layer(packed: str | Column, scale: str | Column, offset: str | Column, fill: str | Column) -> Column:
    p = _c(packed)
    return F.when(p != _c(fill), p * _c(scale) + _c(offset))


def veg_class_code(c: str | Column) -> Column:
    """The number of a vegetation class, null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(VEG_CLASSES.items()))), _c(c))


def scene_date(name: str | Column, start: int = 58, digits: int = 6) -> Column:
    """The date in a scene's path, ``yyMMdd`` (6 digits) or ``yyyyMMdd`` (8); null if it is none."""
    return F.try_to_timestamp(F.substring(_c(name), start, digits), F.lit("yyMMdd" if digits == 6 else "yyyyMMdd")).cast("date")


def scene_key(name: str | Column, start: int = 56, end: int = 77) -> Column:
    return F.substring(_c(name), start, end - start + 1)


def clean_site_name(c: str | Column) -> Column:
    """A file name without its extension, blanks and brackets made underscores and ``&`` spelt out."""
    stem = F.split(_c(c), r"\.")[0]
    return F.translate(F.replace(F.replace(stem, F.lit("&"), F.lit("and")), F.lit(" "), F.lit("_")), "'()#,", "_____")


def path_part(c: str | Column, n: int = -1) -> Column:
    """The n-th element of a path, from 1, or from the end if negative."""
    return F.try_element_at(F.split(_c(c), "/"), F.lit(n))


def zero_pad(c: str | Column, width: int = 3) -> Column:
    return F.lpad(_c(c).cast("string"), width, "0")


def doy_from_year(date: str | Column, year: str | Column) -> Column:
    """Days since the last day of the year before; may be negative or beyond 366."""
    return F.datediff(_c(date), F.make_date(_c(year) - 1, F.lit(12), F.lit(31)))


def date_from_doy(year: str | Column, doy: str | Column) -> Column:
    return F.date_add(F.make_date(_c(year) - 1, F.lit(12), F.lit(31)), _c(doy).cast("int"))


def doy_across_years(date: str | Column, year: str | Column) -> Column:
    """Day of the year, less 365 for a date of the year before and 365 more for one of the year after."""
    d, y = _c(date), _c(year)
    return F.dayofyear(d) + F.when(F.year(d) < y, -365).when(F.year(d) > y, 365).otherwise(0)


def round6(c: str | Column) -> Column:
    return F.bround(_c(c), 6)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once for the row, not once for each element of the lambdas in ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunk_of(cell: str | Column, n_chunks: int | Column, n_cells: str | Column) -> Column:
    """The chunk of a cell numbered from 1: equal shares, what is left over goes to the last."""
    n = F.lit(n_chunks) if isinstance(n_chunks, int) else n_chunks
    share = F.greatest(F.floor(_c(n_cells) / n), F.lit(1))
    return F.least(F.floor((_c(cell) - 1) / share), n - 1) + 1


def shift_point(y: str | Column, metres: float = 30.0) -> Column:
    return _c(y) + F.lit(metres)


def buffer_ring(ring: str | Column, by: float = 0.0015) -> Column:
    """Vertices of a five-point ring, moved outwards: the first and last to the south-west, then anticlockwise."""
    moves = F.array(*(F.struct(F.lit(a * by).alias("lon"), F.lit(b * by).alias("lat")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    return F.zip_with(_c(ring), moves, lambda p, m: F.struct((p["lon"] + m["lon"]).alias("lon"), (p["lat"] + m["lat"]).alias("lat")))


def cell_x(col: str | Column, x0: float, res: float) -> Column:
    return F.lit(x0) + (_c(col) + 0.5) * F.lit(res)


def xy_index(x: str | Column, x0: float, res: float) -> Column:
    """The column (or row, with a negative ``res``) that holds a coordinate."""
    return F.floor((_c(x) - F.lit(x0)) / F.lit(res))


def cell_number(row: str | Column, col: str | Column, n_cols: int | Column) -> Column:
    """Cells counted from 1 along the rows."""
    return _c(row) * n_cols + _c(col) + 1


def linear_interp(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The value at ``x`` on the line through two points; null if they share an ``x``."""
    return y1 + F.try_divide((y2 - y1) * (x - x1), x2 - x1)


def order_name(site: str | Column, batch: str | Column, first: int, last: int) -> Column:
    return F.format_string(f"%s_%02d_{first}_{last}", _c(site), _c(batch))


def direction_code(d: str | Column) -> Column:
    """1 up, 2 down, 0 flat or unknown."""
    d = _c(d)
    return F.when(d > 0, 1).when(d < 0, 2).otherwise(0)


def utm_zone(lon: str | Column, lat: str | Column) -> Column:
    """The UTM zone of a place, 1 to 60, negative in the south; zones are six degrees wide everywhere."""
    zone = F.when(_c(lon) == 180, 60).otherwise(F.floor((_c(lon) + 180) / 6).cast("int") + 1)
    return F.when(_c(lat) < 0, -zone).otherwise(zone)


def _zone(zone: int | str | Column) -> tuple[Column, Column]:
    """A zone's central meridian in degrees, and the northing of the equator."""
    z = F.lit(zone) if isinstance(zone, int) else _c(zone)
    return F.abs(z) * 6.0 - 183, F.when(z < 0, 1e7).otherwise(0.0)


def lonlat_to_utm(lon: str | Column, lat: str | Column, zone: int | str | Column) -> tuple[Column, Column]:
    """WGS84 degrees to UTM metres, by the usual series in the third flattening; negative zones are southern."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = 2 * n**0.5 / (1 + n)
    middle, equator = _zone(zone)
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - middle)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))
    north = xi + sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(alpha, 1))
    return F.lit(500000.0) + F.lit(k0 * radius) * east, equator + F.lit(k0 * radius) * north


def utm_to_lonlat(x: str | Column, y: str | Column, zone: int | str | Column) -> tuple[Column, Column]:
    """The inverse of :func:`lonlat_to_utm`."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    middle, equator = _zone(zone)
    xi, eta = (_c(y) - equator) / F.lit(k0 * radius), (_c(x) - F.lit(500000.0)) / F.lit(k0 * radius)
    xi1 = xi - sum(c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(beta, 1))
    eta1 = eta - sum(c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(beta, 1))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + sum(c * F.sin(2 * j * chi) for j, c in enumerate(delta, 1))
    return middle + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)
