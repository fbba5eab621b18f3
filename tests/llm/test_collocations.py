"""Collocations against plain counting, with and without ranks for all, on odd input; tiles against a counter."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from leafline.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, w string, phrase string, n string, rank string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", "b", "c", "d") for i, (t, lang) in enumerate(rows)], SCHEMA)


def _brute(rows, least, top, longest=4):
    grams, total = {}, Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                grams.setdefault(lang or "und", Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in grams.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in cands.items():
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(left)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def _got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def _rows(rng):
    word = lambda: f"w{int(rng.paretovariate(0.9))}"
    fixed = [[word() for _ in range(rng.randrange(2, 6))] for _ in range(12)]
    rows = []
    for i in range(250):
        out = []
        for _ in range(rng.randrange(0, 40)):
            out += rng.choice(fixed) if rng.random() < 0.4 else [word()]
            out[-1:] = [out[-1] + rng.choice(["", "", "", ".", ",", "?!", "\n", "\x0b", "\t"])]
        rows.append((rng.choice([" ", "  "]).join(out), rng.choice(["en", "en", "en", "de", None])))
    return rows


ODD = [
    ("ha " * 400, "en"), ("Ha, HA ha. hA", "en"), (None, "en"), ("", None), (" \t ", "xx"), ("É é É é x " * 20, "fr"), ("a\x1cb \x00 c " * 20, "und"), ("...,,", "en"),
]


@pytest.mark.parametrize("words,phrases", [(500_000, 1_000_000), (25, 40), (0, 0), (500_000, 15), (12, 1_000_000)])
def test_collocations_equal_plain_counts(spark, monkeypatch, words, phrases):
    """Whether all words and phrases have ranks, some or none."""
    monkeypatch.setattr(co, "RANKED_WORDS", words)
    monkeypatch.setattr(co, "RANKED_PHRASES", phrases)
    monkeypatch.setattr(co, "LOOKED_UP", 50 if words == 25 else -1)
    rows = _rows(random.Random(words)) + ODD
    rows += rows[:5]
    assert _got(co.collocations(_frame(spark, rows).repartition(3), least=6, top=25)) == _brute(rows, 6, 25)


def test_nothing_frequent(spark):
    assert co.collocations(_frame(spark, [])).count() == 0
    assert co.collocations(_frame(spark, [("a b c", "en"), (None, None)])).count() == 0
    pairs = [("x y.", "en")] * 40
    assert _got(co.collocations(_frame(spark, pairs))) == [("en", 1, "x y", 40, 40, 40, 80, 1_000_000)]
    assert _got(co.collocations(_frame(spark, pairs), longest=2)) == [("en", 1, "x y", 40, 40, 40, 80, 1_000_000)]


def test_scores_beyond_64_bits(spark):
    a, big = 2**61 + 12345, 2**62 + 6789
    rows = spark.createDataFrame([("en", [1, 2, 3], "a b c", "c", a, [big, a + 5], [big + 1, big + 77])], "lang string, w array<long>, phrase string, last string, f long, firsts array<long>, rests array<long>")
    got = co.score(rows).first()
    want = min((2000000 * a // (l + r), l, r) for l, r in ((big, big + 1), (a + 5, big + 77)))
    assert (got["score"], got["l"], got["r"]) == want


def test_windows_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(co, "WINDOW", 7)
    data = co.marked([b"One two,three", None, b"four", b"a" * 30 + b" b"])
    assert [w for part in co.windows(data) for w in part] == [b"one", b"two", b"\xff", b"three", b"\xff", b"four", b"\xff", b"a" * 30, b"b"]
    assert list(co.windows(b"")) == []


def test_tiles_count_pairs(monkeypatch):
    """Dense tiles, sparse coordinates and ranks far from the origin, in several turns."""
    monkeypatch.setattr(co, "DENSE_FROM", 300)
    rng = np.random.default_rng(2)
    tiles, want = co.PairTiles(), Counter()
    for turn in range(4):
        a, b = (np.minimum((rng.pareto(0.6, 4000) * 40).astype(np.int64), 2**31 - 1) for _ in range(2))
        tiles.add(a, b)
        want.update(zip(a.tolist(), b.tolist()))
        if turn % 2:
            tiles.settle(3)
    assert 0 < len(tiles.tiles) <= 3
    a, b, c = tiles.out()
    assert Counter(dict(zip(zip(a.tolist(), b.tolist()), c.tolist()))) == want and len(a) == len(want)
    assert not len(tiles.out()[0])


def test_most_frequent_keeps_to_its_limit(spark):
    counted = spark.createDataFrame([(f, f"{f}-{i}") for f in range(1, 40) for i in range(f % 4 + 1)], "f long, x string")
    for limit in (0, 1, 30, 1000):
        rows = co.most_frequent(counted, limit).collect()
        least = min((r["f"] for r in rows), default=99)
        assert len(rows) <= limit and len(rows) == counted.where(f"f >= {least}").count() and (limit < 30 or len(rows) > 15)


@pytest.mark.parametrize("words,phrases", [(4, 1_000_000), (500_000, 3), (4, 3), (0, 0)])
def test_rare_words_and_phrases_are_not_counted_beside_ranks(spark, monkeypatch, words, phrases):
    """Where not all that is frequent has a rank, a phrase of which some part is rare makes no row."""
    monkeypatch.setattr(co, "RANKED_WORDS", words)
    monkeypatch.setattr(co, "RANKED_PHRASES", phrases)
    rng, often = random.Random(3), [f"w{i}" for i in range(12)]
    fixed = [[rng.choice(often) for _ in range(4)] for _ in range(6)]
    rows = [(" ".join([*rng.choice(fixed), f"rare{i}", f"odd{i}", rng.choice(often), f"one{i}"]), rng.choice(["en", "de"])) for i in range(400)]
    made, plain = [], co._phrases
    monkeypatch.setattr(co, "_phrases", lambda *a: made.append((out := plain(*a)).count()) or out)
    assert _got(co.collocations(_frame(spark, rows).repartition(2), least=6)) == _brute(rows, 6, 2000)
    assert len(made) == 3 and sum(made) < 150  # of 6 sequences of 4 words in 2 languages; all phrases are some 5,000
