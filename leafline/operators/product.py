"""The layer product: long and wide rows, catalog, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import pack_layer, unpack_layer
from ..plans.params import FILL, LAYER_NAMES, LAYERS


def layer_catalog(spark: SparkSession) -> DataFrame:
    """The 24 layers, a row each."""
    rows = [(*row[:4], float(row[4]), 0.0, int(row[5]), int(row[6]), FILL) for row in LAYERS]
    names = "product_lyr int, short_name string, long_name string, units string, scale double, offset double, valid_min int, valid_max int, fill_value int"
    return spark.createDataFrame(rows, names)


def to_long(pheno: DataFrame, keys: list[str], layers: list[str] = LAYER_NAMES) -> DataFrame:
    """``(keys, short_name, value)``: a row for each layer; ``layers`` are columns of ``pheno``."""
    values = pheno.select(*keys, *(F.col(f"`{c}`").cast("double").alias(c) for c in layers))
    return values.unpivot(keys, layers, "short_name", "value")


def to_wide(long: DataFrame, keys: list[str], layers: list[str] = LAYER_NAMES) -> DataFrame:
    return long.groupBy(*keys).pivot("short_name", layers).agg(F.first("value"))


def year_layers(long: DataFrame, year: int) -> DataFrame:
    return long.where(F.col("year") == year)


def layer_catalog_join(long: DataFrame) -> DataFrame:
    """Layer values with their catalog row; the catalog has 24 rows and is broadcast."""
    return long.join(F.broadcast(layer_catalog(long.sparkSession)), "short_name")


def pack(long: DataFrame) -> DataFrame:
    """``packed``: the value as a short, or the fill value outside the layer's valid range."""
    return layer_catalog_join(long).withColumn("packed", pack_layer("value", "valid_min", "valid_max", "fill_value"))


def unpack(packed: DataFrame) -> DataFrame:
    return packed.withColumn("unpacked", unpack_layer("packed", "scale", "offset", "fill_value"))
