"""Scans and sinks: everything is read and written by Spark's own sources."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.product import layer_catalog

SCENE_PIXELS = (
    "site_id int, scene_id long, obs_date date, cell long, blue int, green int, red int, nir int, udm int, udm2 int"
)
STATION = (
    "phenocam_site struct<sitename: string, long_name: string, lat: double, lon: double, elevation: double, primary_veg_type: string, "
    "date_start: string, date_end: string>"
)
FEATURES = (
    "features array<struct<id: string, properties: struct<acquired: string, cloud_cover: double, quality_category: string, ground_control: boolean>, "
    "_permissions: array<string>, assets: array<string>>>"
)
SITE = "features array<struct<properties: struct<name: string>, geometry: struct<coordinates: array<array<array<double>>>>>>"


#: Rows of the table of file splits, one for each, up to which it is broadcast, so that no line is shuffled.
BROADCAST_SPLITS = 1_000_000


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local master may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_folder()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_scene_pixels(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Scene rows with the fixed schema; ``where`` reaches the files and, on partition columns, the folders."""
    rows = spark.read.schema(SCENE_PIXELS).parquet(path)
    return rows if where is None else rows.where(where)


def scan_file_index(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """``(path, length)`` of files below ``path`` whose name matches; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length")


def scan_sites(spark: SparkSession, path: str) -> DataFrame:
    """``(site, ring)`` of GeoJSON polygons; the ring's vertices are ``(lon, lat)``."""
    f = spark.read.schema(SITE).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return f.select(F.col("f.properties.name").alias("site"), ring.alias("ring"))


def site_centroid(sites: DataFrame) -> DataFrame:
    """The middle of each ring's bounding box."""
    mid = lambda c: (F.array_min(F.col(f"ring.{c}")) + F.array_max(F.col(f"ring.{c}"))) / 2
    return sites.select("site", mid("lon").alias("c_lon"), mid("lat").alias("c_lat"))


def scan_layer_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(layer_catalog(spark).schema).option("header", True).csv(path)


def scan_csv_skip(spark: SparkSession, path: str, skip: int, schema: str) -> DataFrame:
    """Rows of many CSV files after ``skip`` lines each, with the file's path; large files are read in several splits.

    A line's number is its place within its split plus the lines of the file's splits before it, of
    which there is one small row each. Values may not hold line ends; empty lines are no rows.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    kept = scratch_path(spark, "csv-splits")
    text.groupBy("path", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).write.parquet(kept)
    splits = spark.read.parquet(kept)
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_split")) - F.col("_n")
    splits = splits.select("path", "_split", (before - F.col("_first")).alias("_shift"))
    splits = F.broadcast(splits) if splits.count() <= BROADCAST_SPLITS else splits
    lines = text.join(splits, ["path", "_split"]).where((F.col("_id") + F.col("_shift") >= skip) & (F.col("value") != ""))
    return lines.select("path", F.from_csv("value", schema).alias("r")).select("path", "r.*")


def scan_station_meta(spark: SparkSession, path: str, a_line_each: bool = False) -> DataFrame:
    """Stations' documents: a file each, or many in a file that Spark may split, each on a line of its own."""
    return spark.read.schema(STATION).option("multiLine", not a_line_each).json(path).select("phenocam_site.*")


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Search-result pages, one JSON object a line, to a row for each item."""
    f = spark.read.schema(FEATURES).json(path).select(F.explode("features").alias("f"))
    cols = ("cloud_cover", "quality_category", "ground_control")
    return f.select(
        F.col("f.id").alias("item_id"), F.to_date("f.properties.acquired").alias("acquired"), *(F.col(f"f.properties.{c}") for c in cols),
        F.col("f._permissions").alias("permissions"), F.col("f.assets").alias("assets"),
    )


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page, next, items)``: stored search-result pages by their own link, with the link to the next one and how many items they hold."""
    f = spark.read.schema(f"_links struct<_self: string, _next: string>, {FEATURES}").json(path)
    return f.select(F.col("_links._self").alias("page"), F.col("_links._next").alias("next"), F.coalesce(F.size("features"), F.lit(0)).alias("items"))


def scan_water(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cell long, occ double").parquet(path)


def scan_site_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("site string, flux_code string, veg string").option("header", True).csv(path)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of one folder together, but a folder with many rows in several tasks: Spark splits it by size at run time."""
    return rows.hint("rebalance", *by)


def write_daily(daily: DataFrame, path: str) -> None:
    """Partitioned by site and year; rows of one file are sorted by cell, so that statistics prune."""
    out = _dealt(daily.withColumn("year", F.year("obs_date")), "site_id", "year").sortWithinPartitions("site_id", "year", "cell")
    out.write.partitionBy("site_id", "year").parquet(path)


def write_chunks(chunks: DataFrame, path: str, cell: str = "cell") -> None:
    """Partitioned by chunk, so that one chunk is read alone; files are sorted by cell and have Bloom filters of the cells."""
    out = _dealt(chunks, "chunk").sortWithinPartitions("chunk", cell).write
    out.option(f"parquet.bloom.filter.enabled#{cell}", "true").partitionBy("chunk").parquet(path)


def write_cells(rows: DataFrame, table: str, path: str, buckets: int, keys: tuple[str, ...] = ("site_id", "cell")) -> None:
    """A table in the session's catalog, at ``path``, in buckets of its keys: what is grouped or joined by them is read without a shuffle.

    One file for each bucket, sorted by the keys; choose so many that a bucket fits a task.
    """
    out = rows.repartition(buckets, *keys).sortWithinPartitions(*keys).write
    out.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)


def read_chunk(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("chunk") == chunk)


def read_cells(spark: SparkSession, path: str, cells: list[int], n_chunks: int, n_cells: int, cell: str = "cell") -> DataFrame:
    """Rows of some cells from stored chunks: only their chunks' folders are listed, and of those files the parts that may hold them are read."""
    own = sorted({min((c - 1) // max(n_cells // n_chunks, 1), n_chunks - 1) + 1 for c in cells})
    return spark.read.parquet(path).where(F.col("chunk").isin(own) & F.col(cell).isin(sorted(cells)))


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What is stored at a path; no rows if there is nothing, and none of files that are broken or gone."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resume_chunks(chunks: DataFrame, path: str, date: str = "obs_date") -> DataFrame:
    """Write the chunks that a store lacks or holds in part; ``(chunk, state, n_rows)`` says which were ``kept`` and ``written``.

    Beside the chunks, in ``_complete``, a run leaves what each chunk that it wrote should hold: rows,
    dates and a sum over hashes of its rows. A chunk is complete if that is what the source gives
    now, and the files hold as many rows, which their footers tell. Other chunks replace their
    folder alone (dynamic overwrite), and are told complete only once they are written; so a run that
    breaks off is taken up by the next. Chunks that the source lacks are left alone.
    """
    spark, told = chunks.sparkSession, f"{path}/_complete"
    schema = StructType([StructField("chunk", chunks.schema["chunk"].dataType), *(StructField(n, LongType()) for n in ("n_rows", "n_dates", "total"))])
    row = F.xxhash64(*(c for c in chunks.columns if c != "chunk"))
    own = chunks.groupBy("chunk").agg(F.count("*").alias("n_rows"), F.count_distinct(date).alias("n_dates"), F.sum(F.shiftright(row, 24)).alias("total"))
    kept = scratch_path(spark, "chunks-wanted")
    own.write.parquet(kept)
    wanted = spark.read.parquet(kept)
    held = stored(spark, path, chunks.schema).groupBy("chunk").agg(F.count("*").alias("n_rows"))
    complete = wanted.join(stored(spark, told, schema).distinct(), ["chunk", "n_rows", "n_dates", "total"], "left_semi").join(held, ["chunk", "n_rows"], "left_semi")
    kept = scratch_path(spark, "chunks-complete")
    complete.select("chunk").write.parquet(kept)
    complete = spark.read.parquet(kept)
    missing = wanted.join(complete, "chunk", "left_anti")
    if not missing.isEmpty():
        out = _dealt(chunks.join(missing.select("chunk"), "chunk", "left_semi"), "chunk").sortWithinPartitions("chunk").write
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)
        missing.select(*schema.names).write.mode("append").parquet(told)
    state = F.when(F.col("_kept").isNotNull(), "kept").otherwise("written")
    return wanted.join(complete.withColumn("_kept", F.lit(True)), "chunk", "left").select("chunk", state.alias("state"), "n_rows")


def write_layers(long: DataFrame, path: str) -> None:
    """One folder for each year and layer, named ``NN_YYYY_NAME``."""
    name = F.format_string("%02d_%d_%s", "product_lyr", "year", "short_name")
    _dealt(long.withColumn("layer", name), "layer").write.partitionBy("layer").parquet(path)


def write_product(packed: DataFrame, path: str, attributes: dict[str, str], keys: list[str] = ["site_id", "cell"]) -> None:  # noqa: B006
    """A table for each year with a column of packed values for each layer.

    A layer's row of the catalog (units, scale, valid range, fill value and so on) is its column's
    metadata; ``attributes`` are those of the whole product and stand on the first key. Spark keeps both in
    every file's footer. Layers without values are filled.
    """
    rows = layer_catalog(packed.sparkSession).orderBy("product_lyr").collect()  # 24 rows
    own = F.first("packed", ignorenulls=True)
    wide = packed.groupBy(*keys, "year").pivot("short_name", [r["short_name"] for r in rows]).agg(own)
    for r in rows:
        info = r.asDict()
        wide = wide.withColumn(r["short_name"], F.coalesce(f"`{r['short_name']}`", F.lit(r["fill_value"]).cast("short")))
        wide = wide.withMetadata(r["short_name"], {k: v for k, v in info.items() if v is not None})
    _dealt(wide.withMetadata(keys[0], attributes), "year").write.partitionBy("year").parquet(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """The rows of all tables, columns by name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_match(pairs: DataFrame, path: str) -> None:
    pairs.write.parquet(path)
