"""Hand-made cases of the grouped maps, and checks of each against another form of itself."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.functions import scalar as S
from leafline.operators import cycles, despike, masks, matchup, product, series, similarity
from leafline.operators.spline import smoothing_spline
from leafline.plans.params import FILL, LAYERS, Params

P = Params()


def _flags(vi, days=None, blue=None, red=None, p=P):
    n = len(vi)
    arrays = [np.asarray(x if x is not None else np.full(n, 0.05), float) for x in (blue, red)]
    return despike.spike_flags(*arrays, np.asarray(vi, float), np.asarray(days if days is not None else np.arange(n) * 5), p).tolist()


def test_dip_is_flagged_and_ends_never():
    assert _flags([0.3, 0.3, 0.3, 0.05, 0.3, 0.3, 0.3]) == [False] * 3 + [True] + [False] * 3
    ends = _flags([0.05, 0.3, 0.3, 0.3, 0.05])
    assert not ends[0] and not ends[-1]


def test_cloud_is_flagged():
    up = [0.05, 0.05, 0.15, 0.05, 0.05]
    assert _flags([0.3] * 5, blue=up, red=up)[2]


def test_jump_flags_the_peak_and_its_neighbours():
    first = Params(max_despike_passes=1)
    assert _flags([0.02] * 5 + [0.2] + [0.02] * 5, p=first) == [False] * 4 + [True] * 3 + [False] * 4


def test_too_few_values_flag_nothing():
    assert _flags([0.1, np.nan, 0.3]) == [False] * 3
    assert _flags([np.nan] * 4) == [False] * 4


def test_fixpoint_equals_repeated_passes(spark):
    rng = np.random.default_rng(3)
    rows = [(1, c, date(2017, 1, 1) + timedelta(days=int(4 * i)), 0.05, 0.06, float(0.3 + 0.2 * np.sin(i / 12) - (0.2 if rng.random() < 0.1 else 0))) for c in (1, 2) for i in range(80)]
    obs = spark.createDataFrame(rows, "site_id int, cell int, obs_date date, blue double, red double, vi double")
    left = obs
    for _ in range(50):
        marked = despike.despike_pass(left, P).select(*obs.columns, "spike").collect()
        if not any(r["spike"] for r in marked):
            break
        left = spark.createDataFrame([tuple(r)[:-1] for r in marked if not r["spike"]], obs.schema)
    kept = {(r["cell"], r["obs_date"]) for r in left.collect()}
    whole = {(r["cell"], r["obs_date"]) for r in despike.despike(obs, P).collect() if r["vi"] is not None}
    assert whole == kept and len(kept) < len(rows)


def test_spline_keeps_lines_and_merges_equal_points():
    x = np.arange(0.0, 60, 3)
    at = np.arange(-10.0, 80)
    w = np.linspace(0.5, 2, len(x))
    assert np.allclose(smoothing_spline(x, 2 + 0.1 * x, w, at), 2 + 0.1 * at, atol=1e-8)
    y = np.sin(x / 8)
    doubled = smoothing_spline(np.append(x, x[4]), np.append(y, y[4] + 0.2), np.ones(len(x) + 1), at)
    merged_y, merged_w = y.copy(), np.ones(len(x))
    merged_y[4], merged_w[4] = y[4] + 0.1, 2
    assert np.allclose(doubled, smoothing_spline(x, merged_y, merged_w, at))
    assert smoothing_spline(np.array([1.0, 2, 3]), np.ones(3), np.ones(3), at) is None


def test_spline_between_line_and_interpolation():
    x = np.arange(0.0, 40)
    y = np.sin(x / 5)
    line = np.polyval(np.polyfit(x, y, 1), x)
    assert np.abs(smoothing_spline(x, y, np.ones(40), x, spar=1.5) - line).max() < 1e-2
    assert np.abs(smoothing_spline(x, y, np.ones(40), x, spar=-1.0) - y).max() < 1e-3


@pytest.mark.parametrize(("values", "peaks"), [([1, 2, 3, 2, 1], [2]), ([1, 2, 2, 2, 1], [2]), ([1, 2, 3], []), ([2, 2, 2], []), ([1, 3, 1, 2, 1], [3, 1])])
def test_turning_points(values, peaks):
    assert cycles.turning_points(np.array(values, float)).tolist() == peaks


def test_window_peaks_equal_array_peaks(spark):
    rng = np.random.default_rng(1)
    curves = {k: rng.integers(0, 4, 60).astype(float) for k in range(20)}
    rows = [(k, i + 1, float(v)) for k, c in curves.items() for i, v in enumerate(c)]
    got = cycles.find_peaks(spark.createDataFrame(rows, "k int, day_idx int, v double"), ["k"]).collect()
    for k, c in curves.items():
        assert sorted(r["peak"] - 1 for r in got if r["k"] == k) == sorted(cycles.turning_points(c).tolist())


def _curve(*humps, n=735):
    x = np.full(n, 0.1)
    for peak, height, width in humps:
        x = np.maximum(x, 0.1 + height * np.clip(1 - np.abs(np.arange(n) - peak) / width, 0, None))
    return x


def test_segments():
    (a, b, c), = cycles.segments(_curve((360, 0.5, 100)), P)
    assert b == 361 and a < b < c
    assert len(cycles.segments(_curve((300, 0.5, 60), (450, 0.3, 60)), P)) == 2
    x = _curve((360, 0.5, 100))
    x[300:306] += [0.0, 0.03, 0.05, 0.03, 0.01, 0.0]
    only, = cycles.segments(x, P)
    assert only[1] == 361 and only[0] <= 262
    assert cycles.segments(np.full(735, 0.3), P) == []


def test_dates_of_a_straight_limb(spark):
    x = np.concatenate([np.linspace(0, 1, 101), np.linspace(1, 0, 101)[1:]])
    row = spark.createDataFrame([(x.tolist(), 1, 101, 201)], "curve array<double>, seg_start int, seg_peak int, seg_end int")
    r = cycles.pheno_dates(row, P).first()
    assert [r[f"up{i}"] - 1 for i in (1, 2, 3)] == [15, 50, 90]
    assert [r[f"down{i}"] - 101 for i in (1, 2, 3)] == [10, 50, 85]


def test_qa_classes(spark):
    rows = spark.createDataFrame([(20, 0.75), (21, 0.75), (20, 0.74), (21, 0.74), (20, None)], "g int, r double")
    assert [r[0] for r in rows.select(cycles.qa_class("r", "r", "g", "g", P)).collect()] == [1, 2, 2, 3, None]


def test_packing_borders(spark):
    name = LAYERS[1][1]
    rows = spark.createDataFrame([(name, v) for v in (-182.0, -181.0, 548.0, 549.0, None)], "short_name string, value double")
    packed = {r["value"]: (r["packed"], r["unpacked"]) for r in product.unpack(product.pack(rows)).collect()}
    assert packed == {-182.0: (FILL, None), -181.0: (-181, -181.0), 548.0: (548, 548.0), 549.0: (FILL, None), None: (FILL, None)}


def test_weights(spark):
    base = [float(np.sin(i / 20)) for i in range(200)]
    rows = [(1, 1, 2017, i, v) for i, v in enumerate(base)] + [(1, 1, 2018, i, v) for i, v in enumerate(base)]
    rows += [(1, 1, 2019, i, float(np.mean(base))) for i in range(200)] + [(1, 1, 2020, i, v) for i, v in enumerate(base[:89])]
    curves = spark.createDataFrame(rows, "site_id int, cell int, year int, day_idx int, v double")
    w = {(r["year"], r["other"]): r["weight"] for r in similarity.year_weights(curves, P).collect()}
    assert w[2017, 2018] == pytest.approx(0.5) and w[2017, 2019] == pytest.approx(0, abs=1e-9) and w[2017, 2020] == 0


def test_mask_rules(spark):
    rows = [(1, 1, 1, 1, None, None), (1, 1, 1, 1, 0, 1), (1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 0, 0), (1, 1, 1, 1, None, 0)]
    df = spark.createDataFrame(rows, "blue int, green int, red int, nir int, udm int, udm2 int")
    assert [r["red"] for r in masks.apply_qa_mask(df).collect()] == [1, 1, None, None, 1]
    assert masks.apply_qa_mask(df, strict_udm2=True).collect()[4]["red"] is None


def test_gap_includes_its_start_only(spark):
    days = [date(2017, 1, 1), date(2017, 1, 21), date(2017, 2, 20)]
    obs = spark.createDataFrame([(1, 1, d, 0.3) for d in days], "site_id int, cell int, obs_date date, vi double")
    slots = sorted(r["slot_date"] for r in series.gap_slots(obs, "2017-01-01", "2017-12-31").collect())
    assert slots[0] == date(2017, 1, 21) and slots[-1] == date(2017, 2, 19) and len(slots) == 30


def test_nearest_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([(1, date(2017, 5, 10))], "k int, d date")
    right = spark.createDataFrame([(1, date(2017, 5, 5)), (1, date(2017, 5, 15)), (1, date(2018, 5, 10))], "k int, e date")
    r, = matchup.nearest_within(left, right, ["k"], "d", "e").collect()
    assert r["nearest"] == date(2017, 5, 5) and r["days_apart"] == 5
    assert matchup.nearest_within(left, right.where("e > date '2017-08-17'"), ["k"], "d", "e").count() == 0


def test_utm_of_known_points(spark):
    pts = spark.createDataFrame([(-75.0, 40.0), (-72.1715, 42.5378)], "lon double, lat double")
    x, y = S.lonlat_to_utm("lon", "lat", 18)
    got = pts.select(x.alias("x"), y.alias("y"), "lon", "lat")
    first = got.first()
    assert first["x"] == pytest.approx(500000, abs=1e-3) and first["y"] == pytest.approx(4427757.22, abs=0.05)
    lon, lat = S.utm_to_lonlat("x", "y", 18)
    for r in got.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r["lon"] == pytest.approx(r["lon2"], abs=1e-8) and r["lat"] == pytest.approx(r["lat2"], abs=1e-8)


def test_two_digit_scene_dates(spark):
    df = spark.createDataFrame([("x/170305_ab",), ("short",)], "p string")
    assert [r[0] for r in df.select(S.scene_date("p", 3)).collect()] == [date(2017, 3, 5), None]


def test_batches_over_many_ranges(spark):
    """Numbers go on from range to range, in groups of any size, with repeated items and null groups."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from leafline.operators import catalog

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = spark.range(5000).select(
            F.when(F.col("id") % 7 < 5, F.lit(1)).when(F.col("id") % 7 < 6, F.col("id") % 30).alias("g"), (F.col("id") * 7919 % 2500).cast("string").alias("item_id")
        )
        w = Window.partitionBy("g")
        want = items.select("g", "item_id", F.floor((F.row_number().over(w.orderBy("item_id")) - 1) / 9).cast("int").alias("batch"), (F.ceil(F.count("*").over(w) / 9) > 20).alias("over"))
        got = catalog.id_batches(items, "g", size=9, most=20)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert catalog.id_batches(items.where("false"), "g").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_chain_gives_a_row_for_each_cell_and_year(spark, small):
    from leafline import queries

    out = queries.k16_phenology(spark, small).toPandas()
    cells = spark.read.parquet(f"{small}/supplier.parquet").count()
    assert len(out) == cells * 5 and not out.duplicated(["site_id", "cell", "year"]).any()
    assert out["QA"].isin([1, 2, 3, 4]).all()
    full = out[out["NumCycles"] > 0]
    assert len(full) and (full["OGI"] <= full["50PCGI"]).all() and (full["OGMx"] <= full["Peak"]).all() and (full["Peak"] <= full["OGD"]).all()
    assert full["EVIamp"].between(0, 10000).all()


def test_sources_round_trip(spark, tmp_path):
    from leafline.sources import tables as T

    (tmp_path / "site.json").write_text('{"features": [{"properties": {"name": "a"}, "geometry": {"coordinates": [[[0, 0], [2, 0], [2, 4], [0, 4], [0, 0]]]}}]}')
    c = T.site_centroid(T.scan_sites(spark, str(tmp_path / "site.json"))).first()
    assert (c["c_lon"], c["c_lat"]) == (1.0, 2.0)
    (tmp_path / "t.csv").write_text("x\ny\nrising,gcc_90\nfalling,gcc_50\n")
    rows = T.scan_csv_skip(spark, str(tmp_path / "t.csv"), 2, "direction string, kind string").collect()
    assert [r["direction"] for r in rows] == ["rising", "falling"]
    assert T.scan_file_index(spark, str(tmp_path), "*.csv").count() == 1
    daily = spark.createDataFrame([(1, 7, date(2017, 1, 1), 1.0)], "site_id int, cell int, obs_date date, red double")
    T.write_daily(daily, str(tmp_path / "daily"))
    assert spark.read.parquet(str(tmp_path / "daily")).where(F.col("year") == 2017).count() == 1
    T.write_chunks(daily.withColumn("chunk", F.lit(3)), str(tmp_path / "chunks"))
    assert T.read_chunk(spark, str(tmp_path / "chunks"), 3).count() == 1 and T.read_chunk(spark, str(tmp_path / "chunks"), 4).count() == 0


def test_percentiles_equal_the_aggregate(spark):
    """Ties, nulls, one value, none; the same as the aggregate that holds all distinct values in one task."""
    rows = [(float(i * 37 % 101) / 7, float(i % 3)) for i in range(400)] + [(None, None), (-5.0, 1.0), (1e9, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    for c in ("a", "b"):
        want = df.agg(*(F.percentile(c, F.lit(s)) for s in shares)).first()
        assert matchup.percentiles(df, c, shares) == pytest.approx(list(want))
    assert matchup.percentiles(df.where("a = 1e9"), "a", [0.05, 0.95]) == [1e9, 1e9] and matchup.percentiles(df.limit(0), "a", [0.5]) == [None]
    assert matchup.bandwidths(df, ["a", "b"]) == pytest.approx(list(df.agg(matchup.bandwidth("a"), matchup.bandwidth("b")).first()))


def test_nearest_dates_and_stations_of_one_place_make_no_rows_of_their_own(spark):
    """Against all pairs; left rows stay as they come, and the plan neither multiplies nor groups them."""
    rng = np.random.default_rng(4)
    day = lambda n: date(2015, 1, 1) + timedelta(days=int(n))
    left = [(int(rng.integers(5)), i, day(rng.integers(2000))) for i in range(120)] + [(1, 900, None), (None, 901, day(5))]
    right = [(int(rng.integers(5)), day(rng.integers(2000))) for _ in range(60)] + [(1, None), (2, day(7)), (2, day(7))]
    out = matchup.nearest_within(spark.createDataFrame(left, "k int, i int, d date"), spark.createDataFrame(right, "k int, e date"), ["k"], "d", "e", 40)
    want = []
    for k, i, d in left:
        near = [(abs((d - e).days), e) for q, e in right if d and e and q == k and abs((d - e).days) < 40]
        want += [(k, i, d, min(near)[1], min(near)[0])] if near else []
    assert sorted(map(tuple, out.collect())) == sorted(want) and 20 < len(want) < 120
    stations = [(s, 4.0 * (s % 3), 0.0, "v") for s in range(60)]
    cells = [(1, 4.0 * c, 30.0, 2016 + y, "rising", 100 + 10 * c + y) for c in range(3) for y in range(2)]
    seen = [(s, "rising", date(2016 + y, 4, 1) + timedelta(days=s % 9)) for s in range(60) for y in range(2)]
    asked, plain = [], matchup.buffer_extract
    with pytest.MonkeyPatch.context() as m:
        m.setattr(matchup, "buffer_extract", lambda points, *a: asked.append(points.count()) or plain(points, *a))
        got, = matchup.station_matchup(
            spark.createDataFrame(stations, "station int, x double, y double, veg string"), spark.createDataFrame([(1, -9.0, 99.0, -9.0, 99.0)], "site int, x0 double, x1 double, y0 double, y1 double"),
            spark.createDataFrame(cells, "site int, cx double, cy double, year int, direction string, value int"), spark.createDataFrame(seen, "station int, direction string, seen date"), ["veg"],
        ).collect()
    assert asked == [3] and got["n"] == 120
