"""Near copies by exact Jaccard similarity of word shingles: prefix filter, stars, then what is left between groups."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import BROADCAST_IDS, release_worker, without_ids, written
from .simhash import shingle_hashes

#: Documents that say which shingles are common, and shingles that are told as common. They order shingles and cut nothing.
SAMPLE_DOCS = 20_000
COMMON = 200_000


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as ascending XXH64 values; a text of fewer words is one shingle."""
    return np.unique(shingle_hashes(text, width))


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles, so many that two sets of Jaccard ``least`` share one of them: n - ceil(least n) + 1."""
    n = len(shingles)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")[: n - ceil(least * n - 1e-9) + 1]]


def _common(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of documents, ascending, and their counts."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where((F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < share)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, width).view(np.int64))], names=["s"])

    counted = some.select(text_col).mapInArrow(batches, "s long").groupBy("s").count().where("count > 1")
    rows = counted.orderBy(F.desc("count"), "s").limit(COMMON).toPandas()
    values, counts = rows["s"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text_col, width))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        common, counts = shared.value
        for batch in it:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            cols = [
                batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64()),
                pa.array([prefix(s, common, counts, least).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "set_key", "n", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"id {kind}, set_key binary, n long, prefix array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts have Jaccard ``least``; ``pairs`` should be a written table."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidates")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kind = docs.schema[id_col].dataType.simpleString()

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            raw = [shingle_set(t, width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n = (len(x) + len(y)) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                kept.append(same >= least * (n - same) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    texts = docs.select(F.col(id_col).alias("id"), text_col).join(ids, "id", "left_semi")
    known = written(texts.mapInArrow(sets, f"id {kind}, raw binary"), "shingle-sets")
    both = pairs.join(known.select(F.col("id").alias("a"), F.col("raw").alias("ra")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("raw").alias("rb")), "b").select("a", "b", "ra", "rb")
    return written(both.mapInArrow(close, f"a {kind}, b {kind}"), "near-links")


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8
) -> DataFrame:
    """``(id, component)`` per row with an id: the smallest id that links of Jaccard ``least`` between shingle sets reach.

    Equal sets meet before any join. Two sets of that Jaccard share a shingle of their prefixes;
    any one order of shingles gives that, and rare ones first keeps the groups of a shingle small.
    Each member of a group is compared with its smallest id first; then only pairs of a group that
    are not yet in one component. So a large group of near copies makes no pairs within itself, and
    no pair that could join two components goes without the exact test.
    """
    prints = written(_prints(docs, id_col, text_col, width, least).where("id is not null"), "shingle-prints")
    reps = written(prints.groupBy("set_key").agg(F.min("id").alias("rep")), "shingle-reps")
    named = reps.select("set_key", F.col("rep").alias("id"))
    named = F.broadcast(named) if reps.count() <= BROADCAST_IDS else named
    tokens = prints.join(named, ["set_key", "id"], "left_semi").select("id", "n", F.posexplode("prefix").alias("i", "s"))
    # most shingles are one document's alone: 40 bits of each are counted, in small rows, before any are joined
    bits = F.shiftrightunsigned("s", 24)
    often = tokens.groupBy(bits.alias("bits")).agg(F.count("*").alias("c")).where("c > 1").select("bits")
    often = written(often, "often-bits")
    often = F.broadcast(often) if often.count() <= BROADCAST_IDS else often
    tokens = written(tokens.join(often, bits == F.col("bits"), "left_semi"), "often-shingles")
    stars = tokens.groupBy("s").agg(F.min("id").alias("star"), F.max("id").alias("last")).where("star < last").select("s", "star")
    held = written(tokens.join(stars, "s"), "shared-shingles")
    # so many must be shared; at the first shared shingle so many must be left on both sides
    need = least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9
    fits = (F.col("na") - F.col("ia") >= need) & (F.col("nb") - F.col("ib") >= need) & (F.col("a") < F.col("b"))
    x = held.where("id = star").select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"))
    y = held.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    pairs = written(x.join(y, "s").where(fits).select("a", "b").distinct(), "star-pairs")
    links = _verified(pairs, docs, id_col, text_col, width, least)
    found = written(connected_components(links), "near-comps")
    grouped = held.join(found.withColumnRenamed("node", "id"), "id", "left").select("s", "id", "n", "i", F.coalesce("component", "id").alias("c"))
    mixed = grouped.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("s")
    grouped = written(grouped.join(mixed, "s", "left_semi"), "mixed-shingles")
    x = grouped.select("s", F.col("id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("c").alias("ca"))
    y = grouped.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("c").alias("cb"))
    rest = x.join(y, "s").where(fits & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), "other-pairs")
    if not rest.isEmpty():
        more = _verified(rest, docs, id_col, text_col, width, least)
        if not more.isEmpty():
            found = written(connected_components(links.union(more)), "near-comps")
    named = written(
        reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "set-comps"
    )
    return prints.select("id", "set_key").join(named, "set_key").select(F.col("id").alias(id_col), "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those whose id isn't the smallest of its component; rows with a null id stay."""
    later = components(docs, id_col, text_col, **how).where(F.col(id_col) != F.col("component"))
    return without_ids(docs, written(later.select(id_col), "copies"), id_col)
