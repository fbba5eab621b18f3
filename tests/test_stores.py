"""Stores that are taken up again, split files, result pages, single cells of stored chunks, smoothed density."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline import queries as Q
from leafline.operators import catalog, matchup, mosaic
from leafline.plans import fixtures as X
from leafline.plans import phenology as P
from leafline.sources import tables as T


def _files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _chunk(files, k):
    return {f: t for f, t in files.items() if f"/chunk={k}/" in f}


def test_only_broken_chunks_are_written_again(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 8).alias("chunk"), F.col("id").alias("cell"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("obs_date"))
    path = f"{tmp_path}/chunks"
    states = lambda df: {r["chunk"]: r["state"] for r in df.collect()}
    stored = lambda: sorted(map(tuple, T.stored(spark, path, rows.schema).select(*rows.columns).collect()))
    assert states(T.resume_chunks(rows, path)) == dict.fromkeys(range(8), "written")
    first = _files(path)
    assert states(T.resume_chunks(rows, path)) == dict.fromkeys(range(8), "kept") and _files(path) == first
    # one chunk loses a file, one has a broken file, one has fewer rows than its source has now
    os.remove(next(iter(_chunk(first, 2))))
    broken = next(iter(_chunk(first, 5)))
    with open(broken, "r+b") as f:
        f.truncate(40)
    crc = os.path.join(os.path.dirname(broken), f".{os.path.basename(broken)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    more = rows.union(spark.createDataFrame([(7, 9999)], "chunk long, cell long").withColumn("obs_date", F.lit("2020-05-05").cast("date")))
    assert states(T.resume_chunks(more, path)) == {k: "written" if k in (2, 5, 7) else "kept" for k in range(8)}
    assert stored() == sorted(map(tuple, more.collect()))
    second = _files(path)
    assert all(_chunk(second, k) == _chunk(first, k) for k in (0, 1, 3, 4, 6)) and all(not set(_chunk(second, k)) & set(_chunk(first, k)) for k in (2, 5, 7))
    assert states(T.resume_chunks(more, path)) == dict.fromkeys(range(8), "kept")


def test_lines_are_skipped_across_splits(spark, tmp_path):
    """Files of many splits, also a preamble longer than one; the same rows as from whole files."""
    rng, want = random.Random(1), []
    for k, (skip_too, n) in enumerate([(0, 900), (0, 3), (60, 500), (0, 0)]):
        lines = [f"# preamble {i} {'x' * rng.randrange(90)}" for i in range(70)] + [f"{k}-{i},{i}" for i in range(n)]
        with open(f"{tmp_path}/{k}.csv", "w", newline="") as f:
            f.write(rng.choice(["\n", "\r\n"]).join(lines[:-1] + ([""] * (k == 2)) + lines[-1:]))
        want += [(f"{k}-{i}", i) for i in range(n)]
    had = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = T.scan_csv_skip(spark, str(tmp_path), 70, "name string, i int")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r["name"], r["i"]) for r in rows.collect()) == sorted(want)
    finally:
        for c, v in had.items():
            spark.conf.set(c, v)


def test_chains_of_pages(spark):
    links = {f"a{i}": f"a{i + 1}" for i in range(150)} | {"a150": None, "b0": "b1", "b1": "gone", "c0": "c1", "c1": "c2", "c2": "c1", "d0": "d0", "e0": "a140", "f0": None}
    starts = ["a0", "b0", "c0", "d0", "e0", "f0", "nowhere"]
    want = []
    for s in starts:
        seen, at, state = [], s, "read"
        while at is not None and state == "read":
            state = "circle" if at in seen else "lost" if at not in links else "read"
            want.append((s, len(seen), at, state))
            seen.append(at)
            at = links.get(at)
    pages = spark.createDataFrame([*links.items(), (None, "a0"), ("a0", "a1")], "page string, next string")
    got = catalog.follow_pages(pages, spark.createDataFrame([(s,) for s in [*starts, None, "a0"]], "start string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert catalog.follow_pages(pages, spark.createDataFrame([], "start string")).count() == 0


def test_single_cells_come_from_their_chunk_alone(spark, small, tmp_path):
    """Rows as of the whole product, from one chunk's folder, with the cell pushed to the files."""
    path, n = f"{tmp_path}/chunks", X.table(spark, small, "supplier").count()
    series, water = X.series(spark, small), X.water(spark, small)
    T.write_chunks(mosaic.chunked(series, 5, n), path)
    cells = [3, 4]
    got = P.explain_stored(spark, path, water, cells, 5, n, Q.PARAMS)
    layers = [F.col(f"`{c}`") for c in P.LAYER_NAMES]
    want = P.phenology(series, water, Q.PARAMS).where(F.col("cell").isin(cells)).select(*Q.BY, *layers)
    own = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert own(got.select(*Q.BY, *layers)) == own(want) and got.where("curve is not null and size(days) > 0").count() > 3
    explained = P.explain_pixel(series, water, F.col("cell").isin(cells), Q.PARAMS).select(*Q.BY, F.size("days").alias("n"))
    assert own(got.select(*Q.BY, F.size("days").alias("n"))) == own(explained)
    plan = T.read_cells(spark, path, cells, 5, n)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*chunk", plan) and re.search(r"PushedFilters: \[[^\]]*cell", plan)
    scan = T.read_cells(spark, path, cells, 5, n)._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    assert scan.selectedPartitions().partitionCount() == len({min((c - 1) // (n // 5), 4) for c in cells})


def test_the_chain_of_stored_cells_is_shuffled_by_cell_and_year_alone(spark, small, tmp_path):
    """From a table in buckets of its cells: the same rows, no join by year and no shuffle before the two best cycles meet."""
    series, water = X.series(spark, small), X.water(spark, small)
    try:
        T.write_cells(series, "stored_cells", f"{tmp_path}/cells", 4)
        got = P.phenology(spark.table("stored_cells"), water, Q.PARAMS)
        own = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())
        assert own(got) == own(P.phenology(series, water, Q.PARAMS)) and got.count() > 20
        plan = P.phenology(spark.table("stored_cells"), water, Q.PARAMS)._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert len(shuffles) == 1 and re.search(r"cell#\d+L, year#\d+", shuffles[0]) and "InMemoryTableScan" not in plan, shuffles
    finally:
        spark.sql("drop table if exists stored_cells")


def test_smoothed_density_equals_a_plain_convolution(spark):
    rng = np.random.default_rng(3)
    grid = np.zeros((40, 40))
    for i, j in rng.integers(0, 40, (60, 2)):
        grid[i, j] += rng.integers(1, 9)
    counts = spark.createDataFrame([(int(i), int(j), int(grid[i, j])) for i, j in zip(*np.nonzero(grid))], "bx long, by long, n long")
    wx, wy, hx, hy = 0.5, 2.0, 1.1, 5.0
    kernel = lambda w, h: np.array([[np.exp(-0.5 * ((i - j) * w / h) ** 2) / (h * np.sqrt(2 * np.pi)) if abs(i - j) <= int(3.4 * h / w) else 0.0 for j in range(40)] for i in range(40)])
    want = kernel(wx, hx) @ grid @ kernel(wy, hy).T / grid.sum()
    got = np.zeros((40, 40))
    for r in matchup.smoothed_density(counts, wx, wy, hx, hy, 40).collect():
        got[r["bx"], r["by"]] = r["density"]
    assert np.allclose(got, want, atol=1e-12) and want.sum() * wx * wy == pytest.approx(1, abs=0.2)
    assert matchup.smoothed_density(counts.limit(0), wx, wy, hx, hy, 40).count() == 0


def test_ended_chains_of_pages_are_written_no_more(spark, tmp_path, monkeypatch):
    """One long chain beside many short ones: the rounds of the long one don't write the short ones again."""
    names = iter(range(1000))
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{next(names)}"))
    links = [(f"s{i}", None) for i in range(300)] + [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("a40", None)]
    starts = [(f"s{i}",) for i in range(300)] + [("a0",)]
    out = catalog.follow_pages(spark.createDataFrame(links, "page string, next string"), spark.createDataFrame(starts, "start string"))
    assert out.count() == 341
    wrote = sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir() if p.name.startswith("page-chains"))
    assert wrote < 300 * 2 + 41 * 6
