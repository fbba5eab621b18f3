"""Vector code compression: a codebook for each part of the vectors, fitted by ball k-means in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table_or_shuffle, written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096

Codebook = list[np.ndarray]  # for each part its entries, one below the other


def largest_component(width: int) -> int:
    """Up to this size of whole-number components, four times a vector's squared distance to any entry fits 63 bits."""
    return isqrt((1 << 61) // max(1, width)) // 2


def part_edges(width: int, parts: int = PARTS) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


def whole_numbers(column: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors of a batch take part, and ``floor(scale * x)`` of those."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    x = pc.fill_null(pc.cast(column.filter(fits).flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * scale)
        good = (np.abs(x) <= largest_component(width)).all(axis=1)  # false for NaN and infinity too
    kept = fits.to_numpy(zero_copy_only=False).copy()
    kept[kept] = good
    return kept, x[good].astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def nearest_of_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index, and the squared distance to it."""
    code, best = np.zeros(len(x), np.int64), squared(x, entries[0])
    for j in range(1, len(entries)):
        d = squared(x, entries[j])
        closer = d < best
        code[closer], best[closer] = j, d[closer]
    return code, best


def nearest_by_balls(x: np.ndarray, entries: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest_of_all``, starting from the entries ``last`` that the rows had before the entries moved.

    An entry's rows lie in a ball around it. Only entries at most two radii away (its neighbours)
    can be nearer to any of them. A row closer than half the way to the nearest neighbour is in the
    stable core and keeps its entry; the others lie in the ring between the halves of two
    neighbours' distances, and are compared with the neighbours up to that ring alone. All
    comparisons are of whole numbers, and an entry exactly as near counts, for ties.
    """
    best, code = squared(x, entries[last]), last.copy()
    radius = np.zeros(len(entries), np.int64)
    np.maximum.at(radius, last, best)
    between = squared(entries[:, None], entries[None])
    order = np.argsort(between + np.where(np.eye(len(entries), dtype=bool), -1, 0), axis=1, kind="stable")[:, 1:]  # an entry comes first of its own
    apart = np.take_along_axis(between, order, axis=1)
    neighbours = (apart <= 4 * radius[:, None]).sum(axis=1)
    away = 4 * best
    rows = np.arange(len(x))
    for ring in range(int(neighbours.max(initial=0))):
        own = last[rows]
        rows = rows[(ring < neighbours[own]) & (apart[own, ring] <= away[rows])]
        if not len(rows):
            break
        other = order[last[rows], ring]
        d = squared(x[rows], entries[other])
        closer = (d < best[rows]) | ((d == best[rows]) & (other < code[rows]))
        code[rows[closer]], best[rows[closer]] = other[closer], d[closer]
    return code, best


def encoded(x: np.ndarray, history: list[Codebook], edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each row's parts under the last codebook of ``history``, and their squared distances, a column for each part."""
    codes, errors = np.zeros((len(x), len(edges) - 1), np.int64), np.zeros((len(x), len(edges) - 1), np.int64)
    for p, (a, b) in enumerate(zip(edges, edges[1:])):
        part = np.ascontiguousarray(x[:, a:b])
        code, error = nearest_of_all(part, history[0][p])
        for book in history[1:]:
            code, error = nearest_by_balls(part, book[p], code)
        codes[:, p], errors[:, p] = code, error
    return codes, errors


def _first(rows: DataFrame, width: int, entries: int) -> list[np.ndarray]:
    """The vectors of the smallest ids; null ids come last, equal ids by their vectors."""

    def smallest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kept, x = whole_numbers(batch.column(1), width)
            ids = batch.column(0).filter(pa.array(kept))
            at = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            if len(at) > entries:  # all of the last id that counts, too
                last = ids[int(at[entries - 1])]
                at = np.flatnonzero(pc.fill_null(pc.less_equal(ids, last), False).to_numpy(zero_copy_only=False)) if last.is_valid else at
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(list(x[at]), pa.list_(pa.int64()))], names=["id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "v").mapInArrow(smallest, f"id {kind}, v array<long>")
    return [np.array(r["v"], np.int64) for r in found.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]


def _moved(rows: DataFrame, width: int, history: list[Codebook]) -> Codebook:
    """The codebook after one more round: floored means of each entry's parts; entries without any stay."""
    edges = part_edges(width)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros_like(entries) for entries in history[-1]]
        count = [np.zeros(len(entries), np.int64) for entries in history[-1]]
        for batch in it:
            _, x = whole_numbers(batch.column(0), width)
            codes, _ = encoded(x, history, edges)
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                order = np.argsort(codes[:, p], kind="stable")
                used, at = np.unique(codes[order, p], return_index=True)
                if len(used):
                    total[p][used] += np.add.reduceat(x[order, a:b], at, axis=0)
                    count[p] += np.bincount(codes[:, p], minlength=len(count[p]))
        at = [(p, j) for p, n in enumerate(count) for j in np.flatnonzero(n)]
        cols = [[p for p, _ in at], [int(j) for _, j in at], [int(count[p][j]) for p, j in at], [total[p][j].tolist() for p, j in at]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "total"]
        )

    each = rows.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    each = each.select("part", "entry", "n", F.posexplode("total").alias("at", "total"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    book = [entries.copy() for entries in history[-1]]
    for r in each.groupBy("part", "entry", "at").agg(exact("n"), exact("total")).collect():  # a row for each component of the codebook
        book[r["part"]][r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return book


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[Codebook]]:
    """The width of the vectors, and the codebooks from the first to the one after ``rounds`` rounds.

    A round reads the vectors once more and sends a row for each entry of a task. Which entries the
    rows had before isn't stored: each task works it out again from the codebooks so far (some kB),
    which costs less than writing and reading a row for each vector in every round, and leaves
    nothing behind that an executor could lose. No vectors give width 0 and no codebook.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    usual = rows.where("size(v) > 0").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return 0, []
    width = usual["n"]
    first = _first(rows, width, entries)
    if not first:
        return 0, []
    edges = part_edges(width)
    history = [[np.array([v[a:b] for v in first]) for a, b in zip(edges, edges[1:])]]
    for _ in range(rounds):
        history.append(_moved(rows, width, history))
    return width, history


def digest(book: Codebook) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for entries in book for x in entries.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` for each vector: two hex digits for each of its 8 parts.

    Parts are cut at whole eighths of the length (equal if eight divides it). Rows whose vector is
    null, empty, or holds null or non-finite components are dropped; so are those of another length
    than most (ties: the shorter counts), and those with a component so large that squared distances
    would pass 64 bits (``largest_component``: some 10^8 after scaling at 64 components). Repeated
    rows count and come back as often as they are there. A null id keeps its row; null ids come last
    in the choice of the first entries, and equal ids are told apart by their vectors. Fewer vectors
    than entries give a smaller codebook; a table without any gives no row. ``label_error`` is null
    where it doesn't fit 64 bits. ``label_col`` may be of any type that Spark can group.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    width, history = fit(vectors, id_col, vec_col, entries, rounds)
    kind, label_kind = (vectors.schema[c].dataType.simpleString() for c in (id_col, label_col))
    schema = f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string"
    if not history:
        return vectors.sparkSession.createDataFrame([], schema)
    edges = part_edges(width)

    def coded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kept, x = whole_numbers(batch.column(2), width)
            codes, errors = encoded(x, history, edges)
            own = batch.filter(pa.array(kept))
            hexed = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(hexed, pa.string()), pa.array(errors.sum(axis=1))], names=["id", "label", "code", "error"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    codes = written(rows.mapInArrow(coded, f"id {kind}, label {label_kind}, code string, error long"), "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    by_label = table_or_shuffle(written(by_label, "label-errors"))
    both = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return both.select(
        F.col("id").alias(id_col), "code", "error", F.expr("try_cast(total as long)").alias("label_error"), F.lit(digest(history[-1])).alias("codebooks_sha256")
    )
