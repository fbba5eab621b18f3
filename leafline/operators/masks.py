"""Masks and filters of scene rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir")


def apply_qa_mask(scenes: DataFrame, bands: tuple[str, ...] = BANDS, strict_udm2: bool = False) -> DataFrame:
    """Bands become null where a mask says so.

    With ``udm``: where it is above 0, or ``udm2`` is known and not 1. Without ``udm`` nothing is
    masked, unless ``strict_udm2``, which then goes by ``udm2`` alone.
    """
    bad = F.col("udm").isNotNull() & ((F.col("udm") > 0) | (F.col("udm2").isNotNull() & (F.col("udm2") != 1)))
    if strict_udm2:
        bad = bad | (F.col("udm").isNull() & (F.col("udm2") != 1))
    return scenes.withColumns({b: F.when(~F.coalesce(bad, F.lit(False)), F.col(b)) for b in bands})


def require_four_bands(scenes: DataFrame, n_bands: str = "n_bands") -> DataFrame:
    return scenes.where(F.col(n_bands) == 4)


def join_masks(scenes: DataFrame, masks: DataFrame, key: str = "scene_key", mask: str = "udm") -> DataFrame:
    """Scenes with the mask of their key, null unless exactly one mask has it."""
    single = masks.groupBy(key).agg(F.count("*").alias("_n"), F.first(mask).alias(mask)).where("_n = 1").drop("_n")
    return scenes.join(single, key, "left")


def crop_window(cells: DataFrame, cx: float, cy: float, half: float = 5000.0, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside a square window."""
    return cells.where(F.col(x).between(cx - half, cx + half) & F.col(y).between(cy - half, cy + half))


def point_filter(rows: DataFrame, directions: tuple[str, ...], kind_col: str, kind: str, direction: str = "direction") -> DataFrame:
    """Transition records of the given directions and one kind of value."""
    return rows.where(F.col(direction).isin(*directions) & (F.col(kind_col) == kind))


def row_slice(rows: DataFrame, order: str, first: int, last: int, cols: list[str]) -> DataFrame:
    """Rows ``first`` to ``last`` by order (ties by the other columns), incomplete ones dropped.

    Numbering all rows needs them in one order; a limit keeps each task to its own first rows.
    """
    head = rows.select(order, *[c for c in cols if c != order]).orderBy(order, *[c for c in cols if c != order]).limit(last)
    return head.offset(first - 1).dropna(subset=cols).select(*cols)


def drop_incomplete(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.dropna(subset=cols)
