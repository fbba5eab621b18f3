"""Nearest neighbours by inner product: stable projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

SAMPLE_ROWS = 20_000  # projections that the cells are fitted on
MAX_CELLS = 2048  # of which each has about ten sampled rows at least
BLOCK_ROWS = 8192  # rows that one task searches at once; larger cells are dealt to several blocks
LEAF_ROWS = 256
CHUNK_QUERIES = 4096  # queries that one task searches a block for
PAIRS = 4096  # that are verified at once
SLACK = 1e-9  # relative; products from different routines differ by less


def chi_square_quantile(p: float, dims: int) -> float:
    """Where the chi-square distribution with an even number of degrees reaches ``p``."""

    def cdf(x: float) -> float:
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= x / 2 / (i + 1)
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while cdf(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def _split(points: np.ndarray, rows: int, most: int) -> list[np.ndarray]:
    """Row numbers of kd-tree leaves: halves along the widest side until a leaf has few rows or there are ``most``."""
    leaves, done = [np.arange(len(points))], []
    while leaves and len(leaves) + len(done) < most:
        own = max(leaves, key=len)
        leaves = [x for x in leaves if x is not own]
        spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(1)
        if len(own) <= rows or spread.max() == 0:
            done.append(own)
            continue
        side = points[own, int(spread.argmax())]
        order = own[np.argsort(side, kind="stable")]
        leaves += [order[: len(own) // 2], order[len(own) // 2 :]]
    return done + leaves


def _cuts(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: each node's side and the value that divides it; a full binary tree of ``depth`` levels."""
    nodes, levels = [points], []
    for _ in range(depth):
        sides, values, nxt = [], [], []
        for own in nodes:
            side = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            value = float(np.median(own[:, side])) if len(own) else 0.0
            sides.append(side)
            values.append(value)
            below = own[:, side] <= value if len(own) else np.zeros(0, bool)
            nxt += [own[below], own[~below]]
        levels.append((np.array(sides), np.array(values)))
        nodes = nxt
    return levels


def _cell(points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    cell = np.zeros(len(points), np.int64)
    for sides, values in levels:
        cell = 2 * cell + (points[np.arange(len(points)), sides[cell]] > values[cell])
    return cell


def _outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d][:, None]
        gap = np.maximum(np.maximum(low[:, d] - p, p - high[:, d]), 0)
        out += gap * gap
    return out


def search_block(
    ids: np.ndarray, x: np.ndarray, p: np.ndarray, query_ids: np.ndarray, q: np.ndarray, qp: np.ndarray, bound: np.ndarray,
    k: int, reach: float, lift: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query its ``k`` best rows of a block that score ``bound`` at least: query number, row number, score; and how many rows were verified.

    Leaves of a kd-tree over the projections come nearest first. Of a leaf, only rows are verified,
    with the exact product, whose own projection is so near that they may be nearer than the k-th
    best so far: projected over true squared distance is chi-square distributed, so a row beyond
    ``reach`` times the k-th distance is farther with the wanted confidence. A query stops when that
    holds for all that its next leaf could hold.
    """
    leaves = [x_ for x_ in _split(p, LEAF_ROWS, max(1, len(ids))) if len(x_)]
    low, high = np.array([p[v].min(0) for v in leaves]), np.array([p[v].max(0) for v in leaves])
    away = _outside(qp, low, high)
    turn = np.argsort(away, axis=1, kind="stable")
    own, p2, qp2 = (q * q).sum(axis=1), (p * p).sum(axis=1), (qp * qp).sum(axis=1)
    kth = bound.copy()  # the score that a row must reach
    top = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    active, verified = np.arange(len(q)), 0

    def farthest(of: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return reach * np.maximum(own[of] + lift - 2 * kth[of], 0) * (1 + SLACK) + SLACK

    for step in range(len(leaves)):
        nearest = turn[active, step]
        go = away[active, nearest] <= farthest(active)
        active, nearest = active[go], nearest[go]
        if not len(active):
            break
        found = []
        for leaf in np.unique(nearest):
            mine, rows = active[nearest == leaf], leaves[leaf]
            apart = qp2[mine][:, None] + p2[rows][None] - 2 * (qp[mine] @ p[rows].T)
            a, b = np.nonzero((apart <= farthest(mine)[:, None]) & (ids[rows][None, :] != query_ids[mine][:, None]))
            found.append((mine[a], rows[b]))
        a, b = (np.concatenate(z) for z in zip(*found))
        verified += len(a)
        score = np.concatenate([(q[a[i : i + PAIRS]] * x[b[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(a), PAIRS)] or [np.empty(0)])
        may = score >= kth[a]
        a, b, score = np.concatenate([top[0], a[may]]), np.concatenate([top[1], b[may]]), np.concatenate([top[2], score[may]])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        few = (rank < k) & (score >= bound[a])
        top = (a[few], b[few], score[few])
        full = few & (rank == k - 1)
        kth[a[full]] = np.maximum(kth[a[full]], score[full])
    return *top, verified


def _arrays(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, width)


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    dims: int = 16, confidence: float = 0.85, seed: int = 7, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row where ``is_query`` holds, its ``k`` best other rows.

    The score is the inner product in double precision; ties go to the smaller id. One more
    component turns it into a distance, which random normal projections keep up to a chi-square
    factor. Cells of a kd-tree, fitted on ``SAMPLE_ROWS`` projections, hold every row. A query is
    answered from its own block first; its k-th score there rules out cells by the chi-square
    test, and the blocks of the others are searched with it, each in as many chunks as its own
    visits need; within a block, the test is made for each row by its own projection before the
    exact product. Each true neighbour is found with ``confidence`` at least.

    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components take no part, nor do rows with a null id; rows with the query's id are not its
    candidates. Fewer than ``k`` candidates give all of them.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    empty = "query_id long, rank int, vec_id long, score double".replace("vec_id", f"`{id_col}`")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("is_query"))
    usual = rows.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if usual is None or usual["n"] == 0:
        return spark.createDataFrame([], empty)
    width = usual["n"]

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), width))
            x = pc.fill_null(pc.cast(batch.column(1).flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            kept, x = batch.filter(pa.array(good)), np.ascontiguousarray(x[good])
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), pc.fill_null(kept.column(2), False), raw, pa.array((x * x).sum(axis=1))], names=["id", "is_query", "x", "norm2"]
            )

    good = written(rows.mapInArrow(clean, "id long, is_query boolean, x binary, norm2 double"), "vectors")
    n, lift = good.agg(F.count("*"), F.max("norm2")).first()
    if not n:
        return spark.createDataFrame([], empty)
    # the extra component of a row is sqrt(lift - norm2), that of a query zero
    matrix = np.random.default_rng(seed).standard_normal((width + 1, dims))

    def projected(x: np.ndarray, extra: np.ndarray | None) -> np.ndarray:
        p = x @ matrix[:-1]
        return p if extra is None else p + extra[:, None] * matrix[-1]

    share = min(1.0, 2.0 * SAMPLE_ROWS / n)
    picked = good.withColumn("h", F.xxhash64("id")).where(F.col("h").bitwiseAND(F.lit((1 << 53) - 1)) < share * (1 << 53))
    sample = picked.orderBy("h").limit(SAMPLE_ROWS).select("x", "norm2").toPandas()
    sx = _arrays(sample["x"], width)
    depth = min(int(math.log2(MAX_CELLS)), max(0, math.ceil(math.log2(n / block_rows))), int(math.log2(max(1, len(sx) / 8))))
    levels = _cuts(projected(sx, np.sqrt(np.maximum(lift - sample["norm2"].to_numpy(), 0))), depth)
    cells = 1 << depth

    def placed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = _arrays(pdf["x"], width)
            p = projected(x, np.sqrt(np.maximum(lift - pdf["norm2"].to_numpy(), 0)))
            yield pdf[["id", "is_query", "x"]].assign(p=[r.tobytes() for r in p], cell=_cell(p, levels))

    rows = written(good.mapInPandas(placed, "id long, is_query boolean, x binary, p binary, cell long"), "placed")

    def boxes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high, count = np.full((cells, dims), np.inf), np.full((cells, dims), -np.inf), np.zeros(cells, np.int64)
        for pdf in it:
            p, c = _arrays(pdf["p"], dims), pdf["cell"].to_numpy()
            np.minimum.at(low, c, p)
            np.maximum.at(high, c, p)
            count += np.bincount(c, minlength=cells)
        used = np.flatnonzero(count)
        if not len(used):  # a task without rows
            return
        yield pd.DataFrame({"cell": used, "n": count[used], "low": list(low[used]), "high": list(high[used])})

    part = rows.select("p", "cell").mapInPandas(boxes, "cell long, n long, low array<double>, high array<double>")
    sides = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(dims)] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(dims)]
    box = part.groupBy("cell").agg(F.sum("n").alias("n"), *sides).orderBy("cell").toPandas()  # one row for each cell
    low, high = box[[f"l{i}" for i in range(dims)]].to_numpy(), box[[f"h{i}" for i in range(dims)]].to_numpy()
    salts = np.zeros(cells, np.int64)
    salts[box["cell"]] = -(-box["n"] // block_rows)
    first_block = np.concatenate([[0], np.cumsum(salts)])[:-1]

    def blocks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            c = pdf["cell"].to_numpy()
            mixed = (pdf["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            yield pdf.assign(block=first_block[c] + (mixed % salts[c].astype(np.uint64)).astype(np.int64))[["id", "is_query", "x", "p", "block"]]

    dealt = written(rows.mapInPandas(blocks, "id long, is_query boolean, x binary, p binary, block long"), "blocks")
    reach = chi_square_quantile(confidence, dims)

    def search(key, visits: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(visits) or not len(own):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        q = _arrays(visits["q"], width)
        ids, query_ids = own["own_id"].to_numpy(), visits["query_id"].to_numpy()
        a, b, score, _ = search_block(
            ids, _arrays(own["x"], width), _arrays(own["p"], dims), query_ids, q, projected(q, None), visits["bound"].to_numpy(), k, reach, lift
        )
        return pd.DataFrame({"query_id": query_ids[a], "id": ids[b], "score": score})

    def searched(visits: DataFrame) -> DataFrame:
        wanted = visits.select("block", "chunk").distinct()
        own = dealt.select("block", "id", "x", "p").join(wanted, "block")
        own = own.select(F.col("block").alias("own_block"), F.col("chunk").alias("own_chunk"), F.col("id").alias("own_id"), "x", "p")
        both = visits.groupBy("block", "chunk").cogroup(own.groupBy("own_block", "own_chunk"))
        return both.applyInPandas(search, "query_id long, id long, score double")

    queries = dealt.where("is_query").select(F.col("id").alias("query_id"), F.col("x").alias("q"), "block")
    # a block has few queries of its own
    home = queries.select("query_id", "q", "block", F.lit(0).cast("long").alias("chunk"), F.lit(float("-inf")).alias("bound"))
    near = written(searched(home), "near")
    kth = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))

    def visiting(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = box["cell"].to_numpy()
        for pdf in it:
            q = _arrays(pdf["q"], width)
            bound = pdf["kth"].fillna(float("-inf")).to_numpy()
            d2 = np.maximum((q * q).sum(axis=1) + lift - 2 * bound, 0)
            a, b = np.nonzero(_outside(projected(q, None), low, high) <= (reach * d2)[:, None])
            many = salts[used[b]]
            at = np.repeat(first_block[used[b]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            a = np.repeat(a, many)
            out = pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[a], "q": pdf["q"].to_numpy()[a], "block": at, "bound": bound[a]})
            yield out[at != pdf["block"].to_numpy()[a]]

    visits = queries.join(kth, "query_id", "left").mapInPandas(visiting, "query_id long, q binary, block long, bound double")
    visits = written(visits, "visits")
    load = visits.groupBy("block").agg(F.ceil(F.count("*") / F.lit(chunk_queries)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("query_id"), F.col("chunks")).alias("chunk")
    far = searched(visits.join(load, "block").select("query_id", "q", "block", chunk, "bound"))
    # the best of some blocks at a time first, so that a query of many blocks isn't one long list
    one = F.struct((-F.col("score")).alias("s"), "id")
    parts = near.union(far).groupBy("query_id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("all"))
    best = parts.groupBy("query_id").agg(F.flatten(F.collect_list("all")).alias("all"))
    top = best.select("query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("pos", "c"))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("c.id").alias(id_col), (-F.col("c.s")).alias("score"))
