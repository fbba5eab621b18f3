"""Resampling against the four weights of each cell in plain Python, and across UTM zones against a plane."""

import math
import random

import pytest
from pyspark.sql import functions as F

from leafline.functions import scalar as S
from leafline.operators import mosaic
from leafline.operators.resample import resample, same_grid

IMAGES = "scene_id int, site_id int, ox double, oy double, res double, zone int"
BASES = "site_id int, bx double, by double, bres double, bzone int, n_rows int, n_cols int"


def test_resampling_equals_four_weights(spark):
    """Coarser, finer, shifted and aligned images, nulls and missing pixels, cells off the image."""
    rng = random.Random(1)
    bases = [(1, 1000.0, 2000.0, 3.0, 19, 9, 11), (2, 500.0, 900.0, 3.0, -33, 4, 5)]
    images = [(1, 1, 1000.0, 2000.0, 3.0, 19), (2, 1, 1001.3, 1997.9, 3.7, 19), (3, 1, 990.0, 2010.0, 1.1, 19), (4, 2, 503.0, 903.0, 3.0, -33), (5, 2, 9000.0, 0.0, 3.0, -33), (6, 7, 0.0, 0.0, 3.0, 1)]
    px = {(i, r, c): (None if rng.random() < 0.2 else rng.random(), rng.random()) for i in range(1, 7) for r in range(12) for c in range(13) if rng.random() < 0.85}
    pixels = spark.createDataFrame([(*k, *v) for k, v in px.items()], "scene_id int, row int, col int, red double, nir double")
    want = {}
    for i, site, ox, oy, res, _ in images[:5]:
        _, bx, by, bres, _, n_rows, n_cols = bases[site - 1]
        for r in range(n_rows):
            for c in range(n_cols):
                u, v = (bx + (c + 0.5) * bres - ox) / res - 0.5, (oy - by + (r + 0.5) * bres) / res - 0.5
                sums = [[0.0, 0.0], [0.0, 0.0]]
                for pr in (math.floor(v), math.floor(v) + 1):
                    for pc in (math.floor(u), math.floor(u) + 1):
                        w = (1 - abs(u - pc)) * (1 - abs(v - pr))
                        for k, value in enumerate(px.get((i, pr, pc), (None, None))):
                            if value is not None and w > 0:
                                sums[k][0] += w * value
                                sums[k][1] += w
                if any(s[1] > 1e-9 for s in sums):
                    want[i, r * n_cols + c + 1] = [s[0] / s[1] if s[1] else None for s in sums]
    out = resample(pixels, spark.createDataFrame(images, IMAGES), spark.createDataFrame(bases, BASES), ("red", "nir"))
    got = {(r["scene_id"], r["cell"]): [r["red"], r["nir"]] for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 150
    assert all(a == pytest.approx(b, abs=1e-9) if a is not None and b is not None else a is b for k in want for a, b in zip(got[k], want[k]))
    assert all(got[1, r * 11 + c + 1][1] == pytest.approx(px[1, r, c][1]) for r in range(9) for c in range(11) if (1, r, c) in px)  # on the grid itself
    aligned = {r["scene_id"]: r["aligned"] for r in same_grid(spark.createDataFrame(images, IMAGES), spark.createDataFrame(bases, BASES)).collect()}
    assert aligned == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


@pytest.mark.parametrize("lat", [45.0, -33.0])
def test_images_of_the_next_zone(spark, lat):
    """A plane in the image's own metres is a plane after resampling: values at the cells' places in the other zone."""
    place = spark.range(1).select(F.lit(-66.05).alias("lon"), F.lit(lat).alias("lat"))
    zone = place.select(S.utm_zone("lon", "lat")).first()[0]
    assert zone == (19 if lat > 0 else -19)
    other = zone + 1 if zone > 0 else zone - 1
    bx, by = place.select(*S.lonlat_to_utm("lon", "lat", zone)).first()
    ix, iy = place.select(*S.lonlat_to_utm("lon", "lat", other)).first()
    assert (by > 1e6 * 4) and (lat > 0 or by > 6e6)
    pixels = spark.range(120 * 120).select(F.lit(1).alias("scene_id"), (F.col("id") / 120).cast("int").alias("row"), (F.col("id") % 120).cast("int").alias("col"))
    pixels = pixels.withColumn("red", 0.5 * F.col("col") - 0.25 * F.col("row"))
    images = spark.createDataFrame([(1, 1, ix - 180, iy + 180, 3.0, other)], IMAGES)
    bases = spark.createDataFrame([(1, bx - 60, by + 60, 3.0, zone, 40, 40)], BASES)
    out = resample(pixels, images, bases, ("red",))
    x, y = F.lit(bx - 60) + (F.col("col") + 0.5) * 3, F.lit(by + 60) - (F.col("row") + 0.5) * 3
    lon, lat_ = S.utm_to_lonlat("x", "y", zone)
    out = out.withColumns({"x": x, "y": y}).withColumns({"lon": lon, "lat": lat_})
    tx, ty = S.lonlat_to_utm("lon", "lat", other)
    plane = 0.5 * ((tx - (ix - 180)) / 3 - 0.5) - 0.25 * ((iy + 180 - ty) / 3 - 0.5)
    n, worst = out.agg(F.count("*"), F.max(F.abs(F.col("red") - plane))).first()
    assert n == 1600 and worst < 1e-6


def test_zones(spark):
    rows = [(-180.0, 1.0, 1), (-174.0, -0.1, -2), (0.0, 0.0, 31), (179.99, -60.0, -60), (180.0, 5.0, 60), (None, 1.0, None)]
    df = spark.createDataFrame(rows, "lon double, lat double, want int")
    assert df.where(~S.utm_zone("lon", "lat").eqNullSafe(F.col("want"))).count() == 0


def test_cells_of_two_sites_with_equal_numbers(spark):
    daily = spark.createDataFrame([(1, 1, "d1", 5.0), (2, 1, "d2", 7.0), (2, 2, "d1", 8.0)], "site_id int, cell int, obs_date string, red double")
    grid = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "site_id int, cell int")
    got = sorted(tuple(r) for r in mosaic.align_to_grid(daily, grid).select("site_id", "cell", "obs_date", "red").collect())
    assert got == sorted([(1, 1, "d1", 5.0), (1, 2, "d1", None), (2, 1, "d1", None), (2, 2, "d1", 8.0), (2, 1, "d2", 7.0), (2, 2, "d2", None)], key=lambda r: r[:3])
