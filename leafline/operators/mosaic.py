"""Scenes to daily mosaics, grids, chunks and per-cell arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import chunk_of
from .masks import BANDS, apply_qa_mask, crop_window, require_four_bands

KEYS = ["site_id", "cell"]


def daily_mosaic(scenes: DataFrame, bands: tuple[str, ...] = BANDS, keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """The mean of valid scenes for each cell, date and band; null where no scene is valid."""
    return scenes.groupBy(*keys, date).agg(*(F.avg(b).alias(b) for b in bands))


def align_to_grid(daily: DataFrame, grid: DataFrame, on: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """Every cell of a site's grid on every date that the site has a mosaic for, null where nothing was seen.

    The last of ``on`` is the cell, those before it the site; cells of different sites may share numbers.
    A site's dates are a few thousand at most.
    """
    dates = daily.select(*on[:-1], date).distinct()
    every = grid.join(dates, on[:-1]) if on[:-1] else grid.crossJoin(F.broadcast(dates))
    return every.join(daily, [*on, date], "left")


def daily_pipeline(scenes: DataFrame) -> DataFrame:
    """Masks, then the daily mean: one shuffle, on cell and date, after partial means."""
    return daily_mosaic(apply_qa_mask(scenes))


def scene_pipeline(scenes: DataFrame, grid: DataFrame, cx: float, cy: float, half: float = 5000.0, on: str = "cell", date: str = "obs_date") -> DataFrame:
    """Scenes to a site's gridded days: four-band scenes, masked, inside the window, averaged, on every cell of the window's grid.

    ``scenes`` has ``n_bands`` and each cell's ``x`` and ``y``, as the grid has. Filters come before the one
    shuffle of the means; the grid's days are few and broadcast.
    """
    inside = crop_window(require_four_bands(scenes), cx, cy, half)
    return align_to_grid(daily_mosaic(apply_qa_mask(inside), keys=[on]), crop_window(grid, cx, cy, half).select(on), [on], date)


def to_pixel_arrays(daily: DataFrame, bands: tuple[str, ...] = BANDS, keys: list[str] = KEYS, date: str = "obs_date") -> DataFrame:
    """One row for each cell with its series in date order: as many entries as the cell has dates."""
    return daily.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(date, *bands))).alias("series"))


def chunked(daily: DataFrame, n_chunks: int, n_cells: int, cell: str = "cell") -> DataFrame:
    return daily.withColumn("chunk", chunk_of(cell, n_chunks, F.lit(n_cells)))


def chunk_completeness(chunks: DataFrame, date: str = "obs_date") -> DataFrame:
    """``(chunk, n_dates, complete)``: complete if the chunk has as many dates as there are at all."""
    total = chunks.agg(F.count_distinct(date).alias("n_all"))
    per = chunks.groupBy("chunk").agg(F.count_distinct(date).alias("n_dates"))
    return per.crossJoin(F.broadcast(total)).select("chunk", "n_dates", (F.col("n_dates") == F.col("n_all")).alias("complete"))


def merge_chunks(grid: DataFrame, parts: DataFrame, on: list[str]) -> DataFrame:
    """All cells of the grid with what the chunks hold of them; cells of missing chunks stay null."""
    return grid.join(parts, on, "left")


def grid_extent(images: DataFrame, res: float, x: str = "x", y: str = "y") -> DataFrame:
    """The cells of the union of image extents: ``(row, col, x, y)``, rows from the top."""
    e = images.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rows = e.select("*", F.explode(F.sequence(F.lit(0), F.round((F.col("y1") - F.col("y0")) / res).cast("int"))).alias("row"))
    # one task made the rows; each row's cells are made where it is dealt to
    cells = rows.repartition("row").select("*", F.explode(F.sequence(F.lit(0), F.round((F.col("x1") - F.col("x0")) / res).cast("int"))).alias("col"))
    return cells.select("row", "col", (F.col("x0") + F.col("col") * res).alias("x"), (F.col("y1") - F.col("row") * res).alias("y"))
