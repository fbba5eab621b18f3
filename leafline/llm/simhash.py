"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then exact Hamming distances."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import release_worker, without_ids, written

#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SEED = 42


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; the whole sequence if it has fewer words; none for no word."""
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.empty(0, np.uint64)
    joined = [" ".join(words)] if len(words) < width else map(" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s.encode(), SEED) for s in joined), np.uint64)


def _bit_votes(hashes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return votes


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash: a bit is 1 if set in over half of the shingle hashes; zero for no word."""
    hashes = shingle_hashes(text, width)
    bits = (2 * _bit_votes(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint as a signed long. Null text counts as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, fp long")


def _choices(free: list[int], blocks: int, distance: int) -> list[tuple[list[int], list[int]]]:
    """The bit positions ``free`` in ``blocks`` runs: for each choice of ``blocks - distance`` runs, its bits and the others.

    At most ``distance`` runs hold a differing bit, so fingerprints that are equal outside ``free``
    and within ``distance`` bits agree on all runs of one choice at least.
    """
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    runs = [free[a:b] for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(range(blocks), blocks - distance):
        same = [p for i in chosen for p in runs[i]]
        out.append((same, [p for p in free if p not in set(same)]))
    return out


def _masked(fp: str, positions: list[int]):
    mask = sum(1 << p for p in positions)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _matches(keyed: DataFrame, fp: str, distance: int) -> DataFrame:
    a = keyed.withColumnRenamed(fp, "fa")
    b = keyed.withColumnRenamed(fp, "fb")
    apart = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb")))
    return a.join(b, ["part", "bits"]).where((F.col("fa") < F.col("fb")) & (apart <= distance)).select("fa", "fb", apart.alias("bits"))


def near_pairs(prints: DataFrame, fp: str = "fp", distance: int = 2, blocks: int = 4, crowded: int = 2000) -> DataFrame:
    """``(fa, fb, bits)`` for distinct fingerprints ``fa < fb`` that differ in at most ``distance`` bits.

    ``prints`` must hold each fingerprint once. Four blocks and two bits give six keys of 32 bits
    each, so a key is shared by chance only beyond billions of fingerprints; the join's own
    condition is the Hamming test, so no other pair leaves it. Fingerprints that aren't spread
    evenly may crowd a key: one with over ``crowded`` of them isn't joined as it is, but its free
    bits are cut into blocks in turn (six keys of 48 bits, then of 56), which loses no pair. After
    the second cut 8 bits are free, so no key holds more than 256 fingerprints, whatever the data.
    """
    if not 0 <= distance < blocks:
        raise ValueError("distance must be below the number of blocks")
    choices = _choices(list(range(64)), blocks, distance)
    keys = [F.struct(F.lit(str(n)).alias("part"), _masked(fp, same).alias("bits")) for n, (same, _) in enumerate(choices)]
    keyed = prints.select(fp, F.explode(F.array(*keys)).alias("k")).select(fp, "k.part", "k.bits")
    free = {str(n): rest for n, (_, rest) in enumerate(choices)}
    found = None
    while True:
        full = None
        if max(map(len, free.values())) > max(8, blocks):
            full = keyed.groupBy("part", "bits").count().where(F.col("count") > crowded).select("part", "bits")
            full = written(full, "crowded-keys")
            # a few names at most: one for each choice of blocks
            parts = sorted(r["part"] for r in full.select("part").distinct().collect())
        if full is None or not parts:
            pairs = _matches(keyed, fp, distance)
            return (pairs if found is None else found.union(pairs)).distinct()
        roomy = _matches(keyed.join(full, ["part", "bits"], "left_anti"), fp, distance)
        found = roomy if found is None else found.union(roomy)
        finer, free_next = [], {}
        for part in parts:
            outside = [p for p in range(64) if p not in free[part]]
            subs = []
            for n, (same, rest) in enumerate(_choices(free[part], blocks, distance)):
                name = f"{part}.{n}"
                free_next[name] = rest
                subs.append(F.struct(F.lit(name).alias("part"), _masked(fp, outside + same).alias("bits")))
            finer.append(F.when(F.col("part") == part, F.array(*subs)))
        crowd = keyed.join(full, ["part", "bits"], "left_semi").select(fp, F.explode(F.coalesce(*finer)).alias("k"))
        keyed, free = written(crowd.select(fp, "k.part", "k.bits"), "crowded-prints"), free_next


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    distance: int = 2,
    blocks: int = 4,
    crowded: int = 2000,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id that links of at
    most ``distance`` bits reach, the row's own included. Exact copies meet in one fingerprint
    before any join. Null and empty texts have fingerprint zero and link like any other; rows
    repeat as often as they came; a null id keeps its row and never names a component.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "simhash")
    reps = written(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-reps")
    pairs = near_pairs(reps.select("fp"), "fp", distance, blocks, crowded)
    links = (
        pairs.join(reps.select(F.col("fp").alias("fa"), F.col("rep").alias("a")), "fa")
        .join(reps.select(F.col("fp").alias("fb"), F.col("rep").alias("b")), "fb")
        .select("a", "b")
    )
    comps = connected_components(links).withColumnRenamed("node", "rep")
    named = written(
        reps.join(comps, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "simhash-comps"
    )
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp", "left").select(id_col, hexed.alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those whose id isn't the smallest of its component: one document of each group.

    Rows that share an id are one document and stay together; rows with a null id stay.
    """
    later = near_duplicates(docs, id_col, text_col, **how).where(F.col(id_col) != F.col("component_id"))
    return without_ids(docs, written(later.select(id_col), "copies"), id_col)
