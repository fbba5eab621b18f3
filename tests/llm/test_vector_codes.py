"""Vector codes against plain whole-number k-means, and on odd input."""

import hashlib

import numpy as np
import pytest

from leafline.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, of string, id string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def _brute(rows, entries=16, rounds=6):
    """``(vec_id, code, error, label_error)`` sorted, and the digest; Python integers only."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    edges = [width * i // 8 for i in range(9)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(edges, edges[1:])]

    def near(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(p, v[a:b])[1], []).append(v[a:b])
            for j, parts in own.items():
                books[p][j] = [sum(c) // len(parts) for c in zip(*parts)]
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(p, v[a:b]) for p, (a, b) in enumerate(zip(edges, edges[1:]))]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, c, e, by_label[k]) for i, c, e, k in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def _got(df):
    rows = df.collect()
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr), {r["codebooks_sha256"] for r in rows}


def test_codes_equal_plain_k_means(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 24)).round(2)
    x[50:250] = x[50] + rng.integers(-1, 2, (200, 24)) / 4096  # a crowd
    x[300:330] = x[3]  # copies, one of them a first entry
    x[5] = x[4]  # two equal first entries
    rows = [(int(i), v.tolist(), int(i) % 5 if i % 7 else None) for i, v in enumerate(x)]
    rows += [rows[7], rows[7], (None, x[9].tolist(), None), (None, x[10].tolist(), 3)]
    bad = [(900, None, 1), (901, [None] * 24, 1), (902, [float("nan")] * 24, 1), (903, [float("inf")] + [0.0] * 23, 1), (904, [1.0], 1), (905, [], 1), (906, [1e300] * 24, 1)]
    want, sha = _brute(rows)
    got, shas = _got(vc.compress(_frame(spark, rows + bad).repartition(5)))
    assert got == want and shas == {sha}


def test_codes_of_few_rows_and_odd_widths(spark):
    assert vc.compress(_frame(spark, [])).count() == 0
    assert vc.compress(_frame(spark, [(1, None, 1), (2, [], 1), (3, [None] * 8, 2)])).count() == 0
    rows = [(i, [i / 3, float(-i), 7.5, float(i * i), 1e4 * i], i % 2) for i in range(5)]  # parts of none or one component
    want, sha = _brute(rows)
    assert _got(vc.compress(_frame(spark, rows))) == (want, {sha})
    with pytest.raises(ValueError):
        vc.compress(_frame(spark, rows), entries=257)


def test_balls_give_the_nearest_entry():
    """Large, equal and tied entries, from any start."""
    rng = np.random.default_rng(3)
    for top in (3, 50, vc.largest_component(8)):
        x, entries, last = rng.integers(-top, top + 1, (500, 8)), rng.integers(-top, top + 1, (16, 8)), rng.integers(0, 16, 500)
        entries[9] = entries[2]
        exact = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)), j) for j, e in enumerate(entries)) for r in x]
        for code, best in (vc.nearest_of_all(x, entries), vc.nearest_by_balls(x, entries, last)):
            assert code.tolist() == [j for _, j in exact] and best.tolist() == [d for d, _ in exact]


def test_stable_cores_are_left_alone(monkeypatch):
    """Rows close to their entries are compared with no other entry."""
    entries = np.arange(16)[:, None] * np.full((1, 4), 1000)
    x = np.repeat(entries, 100, axis=0) + np.random.default_rng(0).integers(-50, 51, (1600, 4))
    seen, plain = [], vc.squared
    monkeypatch.setattr(vc, "squared", lambda a, b: seen.append(a.size) or plain(a, b))
    code, _ = vc.nearest_by_balls(x, entries, np.repeat(np.arange(16), 100))
    assert code.tolist() == np.repeat(np.arange(16), 100).tolist() and sum(seen) == x.size + 16 * 4
