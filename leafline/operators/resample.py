"""Images of another origin, resolution or UTM zone on to a site's base grid, by bilinear weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cell_number, let, lonlat_to_utm, utm_to_lonlat
from .masks import BANDS


def _into(x: Column, y: Column, zone: Column, other: Column) -> Column:
    """UTM metres of one zone in another as ``(x, y)``; the same zone leaves them as they are, at no cost."""
    place = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    moved = let(place(utm_to_lonlat(x, y, zone)), lambda p: place(lonlat_to_utm(p["x"], p["y"], other)))
    return F.when(zone == other, place((x, y))).otherwise(moved)


def resample(
    pixels: DataFrame, images: DataFrame, bases: DataFrame, bands: tuple[str, ...] = BANDS, image: str = "scene_id", site: str = "site_id"
) -> DataFrame:
    """``(site, image, cell, row, col, bands)``: each base cell's value between the centres of the four pixels around it.

    ``pixels`` has the image, ``row`` and ``col`` from its upper left pixel, 0, and the bands;
    ``images`` the image, its site, ``ox`` and ``oy`` (the upper left corner), ``res`` and the UTM ``zone``
    (negative in the south); ``bases`` the site, ``bx``, ``by``, ``bres``, ``bzone``, ``n_rows`` and ``n_cols``.
    A base cell's centre is mapped back into the image; a pixel there counts by how near it is, up to
    one pixel's width in both directions. Null or missing pixels are left out and the weights of the
    others are scaled up; a cell without any has no row, a band without any is null. An image on the
    base grid itself comes back as it is.

    Every pixel is dealt to the base cells it may count for, and their weighted sums are made before
    the one shuffle, by image and cell: no image meets a whole grid.
    """
    c = F.col
    info = images.select(image, site, "ox", "oy", "res", "zone").join(bases.select(site, "bx", "by", "bres", "bzone", "n_rows", "n_cols"), site)
    p = pixels.select(image, "row", "col", *bands).join(info, image)
    # zones are turned against each other by less than a right angle's half
    reach = F.when(c("zone") == c("bzone"), c("res")).otherwise(c("res") * 1.5) / c("bres")

    def around(at: Column) -> Column:
        """The base cells whose centres may be within a pixel's width."""
        low = lambda v: F.greatest(F.ceil(v - reach), F.lit(0)).cast("long")
        high = lambda v, n: F.least(F.floor(v + reach), c(n) - 1).cast("long")
        row, col = (c("by") - at["y"]) / c("bres") - 0.5, (at["x"] - c("bx")) / c("bres") - 0.5
        box = F.struct(low(row).alias("r0"), high(row, "n_rows").alias("r1"), low(col).alias("c0"), high(col, "n_cols").alias("c1"))
        run = lambda b, k: F.sequence(b[f"{k}0"], b[f"{k}1"])
        cells = lambda b: F.flatten(F.transform(run(b, "r"), lambda r: F.transform(run(b, "c"), lambda k: F.struct(r.alias("r"), k.alias("c")))))
        return let(box, lambda b: F.when((b["r0"] <= b["r1"]) & (b["c0"] <= b["c1"]), cells(b)))

    def weight(at: Column) -> Column:
        near = lambda a, b: F.greatest(F.lit(0.0), 1 - F.abs(a - b))
        return near((at["x"] - c("ox")) / c("res") - 0.5, c("col")) * near((c("oy") - at["y"]) / c("res") - 0.5, c("row"))

    # positions stay within one expression each: as columns, every filter would write out their series again
    here = _into(c("ox") + (c("col") + 0.5) * c("res"), c("oy") - (c("row") + 0.5) * c("res"), c("zone"), c("bzone"))
    p = p.withColumn("_to", F.explode_outer(let(here, around)))
    there = _into(c("bx") + (c("_to.c") + 0.5) * c("bres"), c("by") - (c("_to.r") + 0.5) * c("bres"), c("bzone"), c("zone"))
    p = p.withColumn("_w", let(there, weight))
    mean = lambda b: F.try_divide(F.sum(c("_w") * c(b)), F.sum(F.when(c(b).isNotNull(), c("_w")))).alias(b)
    out = p.groupBy(site, image, c("_to.r").alias("row"), c("_to.c").alias("col"), "n_cols").agg(F.sum("_w").alias("_all"), *map(mean, bands))
    return out.where("_all > 0").select(site, image, cell_number("row", "col", c("n_cols")).alias("cell"), "row", "col", *bands)


def same_grid(images: DataFrame, bases: DataFrame, site: str = "site_id") -> DataFrame:
    """``images`` with ``aligned``: whether their pixels are base cells, so that :func:`resample` isn't needed."""
    on = lambda a, b: F.abs((F.col(a) - F.col(b)) / F.col("bres") - F.round((F.col(a) - F.col(b)) / F.col("bres"))) < 1e-6
    own = bases.select(site, "bx", "by", "bres", "bzone")
    aligned = (F.col("zone") == F.col("bzone")) & (F.col("res") == F.col("bres")) & on("ox", "bx") & on("oy", "by")
    return images.join(own, site, "left").withColumn("aligned", F.coalesce(aligned, F.lit(False))).select(*images.columns, "aligned")
