"""Observation-like tables derived from the given ones, so that every operator has input that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mosaic import daily_pipeline
from ..operators.series import interpolated_curve, vegetation_series, year_windows
from .params import Params

PARAMS = Params(years=(1996, 1997, 1998, 1999, 2000), dormant_from="1996-01-01", dormant_to="2000-12-31")

#: Rings of two polygons: a square whose east side is notched to its middle; a square with a hole, and a triangle apart from it.
NOTCHED = [[(0, 0), (6, 0), (3, 3), (6, 6), (0, 6), (0, 0)]]
RINGED = [[(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)], [(1, 1), (1, 4), (4, 4), (4, 1), (1, 1)], [(7, 0), (9, 0), (9, 3), (7, 0)]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene pixels: site = region, cell = supplier, scene = order line; a triangle season, some cloud and masks."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    line = line.join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    day = F.col("l_shipdate").cast("date")
    season = F.greatest(F.lit(0), 150 - F.abs(F.dayofyear(day) - 197))
    q = F.col("l_quantity")
    off, tax = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    cloud = lambda v: F.when(off == 10, v).otherwise(0)
    return line.select(
        F.col("n_regionkey").alias("site_id"), F.col("l_suppkey").alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene_id"),
        day.alias("obs_date"),
        (300 + 2 * q + cloud(1500)).cast("int").alias("blue"), (500 + 3 * q).cast("int").alias("green"),
        (900 - 4 * season + q + cloud(1500)).cast("int").alias("red"), (1500 + 18 * season + 5 * q + cloud(300)).cast("int").alias("nir"),
        F.when(F.col("l_returnflag") != "N", F.when(tax == 8, 1).otherwise(0)).alias("udm"),
        F.when(F.col("l_linestatus") != "O", F.when(off == 9, 0).otherwise(1)).alias("udm2"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vegetation_series(daily_pipeline(obs(spark, sf_dir)))


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") % 101).cast("double").alias("occ"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    row, col = F.floor(s / 10).cast("long"), (s % 10).cast("long")
    return table(spark, sf_dir, "supplier").select(
        s.alias("cell"), row.alias("row"), col.alias("col"), (500001.5 + 3 * col).alias("x"), (4000001.5 - 3 * row).alias("y")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("item_id"), (F.col("o_custkey") % 50).alias("cell_group"), F.col("o_orderdate").cast("date").alias("acquired"),
        ((o % 100).cast("double") / 100).alias("cloud_cover"), F.when(F.col("o_orderstatus") == "F", "standard").otherwise("test").alias("quality_category"),
        (o % 7 != 0).alias("ground_control"),
    )


def orders_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that were ordered before: three fifths of them, so that some are left."""
    done = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 50 < 30))
    return done.select((F.col("o_custkey") % 50).alias("cell_group")).distinct()


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stations, each 1.2 m beside the centre of a grid cell; they are spread over all cells."""
    k = F.col("c_custkey") % table(spark, sf_dir, "supplier").count()
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("station"), (500001.5 + 3 * (k % 10) + 1.2).alias("x"), (4000001.5 - 3 * F.floor(k / 10) - 1.2).alias("y")
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a footprint of whole coordinates: a square with a notch, or one with a hole and a triangle beside it."""
    o, size = F.col("item_id"), F.col("item_id") % 5 + 1
    at = lambda p: F.struct((o * 37 % 1009 + p[0] * size).cast("double").alias("x"), (o * 91 % 1013 + p[1] * size).cast("double").alias("y"))
    shape = lambda rings: F.array(*(F.array(*map(at, r)) for r in rings))
    return items(spark, sf_dir).withColumn("rings", F.when(o % 3 == 0, shape(RINGED)).otherwise(shape(NOTCHED)))


def site_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, rings)``: polygons of suppliers, from a few metres to the whole area, with holes of their own size."""
    s, size = F.col("s_suppkey"), F.when(F.col("s_suppkey") % 25 == 0, 150).otherwise(F.col("s_suppkey") % 7 + 1)
    at = lambda p: F.struct((s * 53 % 1009 + p[0] * size).cast("double").alias("x"), (s * 71 % 1013 + p[1] * size).cast("double").alias("y"))
    shape = lambda rings: F.array(*(F.array(*map(at, r)) for r in rings))
    return table(spark, sf_dir, "supplier").select(s.alias("site"), F.when(s % 2 == 0, shape(RINGED)).otherwise(shape(NOTCHED)).alias("rings"))


def site_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's cells with their centres."""
    regions = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("site"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("n_nationkey"))
    cells = grid(spark, sf_dir).select("cell", "row", "col", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return own.join(regions, "n_nationkey").drop("n_nationkey").join(cells, "cell")


def site_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, x0, x1, y0, y1)`` of the sites' cells, which are 3 m wide."""
    least, most = (lambda c: F.min(c) - 1.5), (lambda c: F.max(c) + 1.5)
    return site_cells(spark, sf_dir).groupBy("site").agg(least("cx").alias("x0"), most("cx").alias("x1"), least("cy").alias("y0"), most("cy").alias("y1"))


def yearly_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, cell, year, layer, value)``: the largest value and the amplitude of each year, in whole ten-thousandths."""
    s = series(spark, sf_dir).where("vi is not null").groupBy(F.col("site_id").alias("site"), "cell", F.year("obs_date").alias("year"))
    hi, lo = F.round(F.max("vi") * 10000), F.round(F.min("vi") * 10000)
    rows = s.agg(hi.alias("hi"), lo.alias("lo")).select("site", "cell", "year", F.expr("stack(2, 'EVImax', hi, 'EVIamp', hi - lo) as (layer, value)"))
    return rows


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily curve that needs no spline: straight lines between observations."""
    return interpolated_curve(series(spark, sf_dir))


def curve_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site_id, cell, year, day_idx, v)``: the daily curve in the windows of the product years."""
    slots = year_windows(curve(spark, sf_dir), PARAMS.years, PARAMS.spline_buffer, "slot_date")
    return slots.select("site_id", "cell", "year", "day_idx", F.col("vi").alias("v"))
