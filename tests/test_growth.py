"""What keeps time and memory in proportion to the input."""

import numpy as np
import pyarrow as pa
from leafline.operators import cycles, similarity
from leafline.operators.batches import in_parts
from leafline.plans import fixtures as X
from leafline.plans import phenology as P
from leafline.plans.fixtures import PARAMS


def test_likeness_of_years_passes_python_with_the_splines(spark, small):
    """rows pass Python for spikes, curves and cycles, and no pairs of years are compared slot by slot in the plan."""
    plan = P.phenology(X.series(spark, small), X.water(spark, small), PARAMS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "zip_with" not in plan.split("MapInArrow")[1]


def test_array_weights_equal_the_expressions(spark):
    rng = np.random.default_rng(5)
    vs = rng.random((4, 3, 366))
    vs[rng.random(vs.shape) < 0.3] = np.nan
    vs[0, 1], vs[1, 2, 50:] = np.nan, np.nan
    vs[2, 0, :] = 0.25
    rows = [(c, 2000 + y, [None if np.isnan(v) else float(v) for v in vs[c, y]]) for c in range(4) for y in range(3)]
    told = similarity.array_weights(spark.createDataFrame(rows, "cell long, year int, vs array<double>"), PARAMS, ["cell"]).collect()
    got = similarity.cell_weights(vs, PARAMS)
    want = np.zeros_like(got)
    for r in told:
        want[r["cell"], r["year"] - 2000, r["other"] - 2000] = r["weight"]
    assert np.array_equal(got, want) and (got > 0).any()


def test_python_works_on_parts_of_a_batch_and_lets_them_go():
    """F8: whatever a batch's size, a part has few rows, and a batch is free before the next but one is read."""
    sizes, before = [], pa.total_allocated_bytes()

    def batches():
        for _ in range(3):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1000.0)).cast(pa.float32()).cast(pa.float64())], names=["v"])
            assert pa.total_allocated_bytes() - before < 2 * 1000 * 8

    def work(batch):
        sizes.append(batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert sum(b.column(0)[0].as_py() for b in in_parts(work, 64)(batches())) == 3000
    assert max(sizes) == 64 and len(sizes) == 48


def test_cycles_are_looked_for_in_arrow_batches(spark):
    """F8: no curve becomes a pandas object."""
    found = cycles.find_segments(spark.createDataFrame([(1, [0.1] * 735)], "cell long, curve array<double>"), ["cell"], PARAMS)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString() and found.first()["segs"] == []
