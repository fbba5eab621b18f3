"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of at most so many rows (some 60 MB as a hash table) are broadcast; more are shuffled.
BROADCAST_IDS = 2_000_000


#: What this Python worker keeps between tasks.
_held: dict[Hashable, Any] = {}


def release_worker() -> None:
    """Let go of what earlier tasks of another operator left in this Python worker."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def small_batches(it: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what Python makes of one stays small beside the batch; freed memory goes back after each batch."""
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def held_by_worker(key: Hashable, make: Callable[[], Any]) -> Any:
    """The value of ``key``, made once in a Python worker and kept for its next tasks.

    Spark gives a worker the tasks of one operator after another, so only the last key is kept:
    the tables of several would add up beside the executor's heap.
    """
    if key not in _held:
        release_worker()
        _held[key] = make()
    return _held[key]


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a ``local`` master may leave it unset; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local_folder()
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it as read from there.

    This cuts the lineage and survives the loss of executors; the files live as long as the
    folder's own retention says.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_or_shuffle(small: DataFrame, rows: int | None = None) -> DataFrame:
    """``small``, a written table, told to be broadcast if it has at most ``rows`` (``BROADCAST_IDS``) rows; left to shuffle beyond."""
    return F.broadcast(small) if small.count() <= (BROADCAST_IDS if rows is None else rows) else small


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` but for the rows whose id is in ``ids``; null ids stay. ``ids`` should be a written table."""
    ids = ids.select(id_col).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, id_col, "left_anti").select(*docs.columns)
