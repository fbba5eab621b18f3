"""MinHash near-duplicates against all pairs, on odd input and crowded keys, and the pruning test's error."""

import random
import re
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafline.llm import minhash

SCHEMA = "doc_id long, text string, node string, n string, key string, set_key string, component_id string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v") for r in rows], SCHEMA)


def _set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def _brute(rows, width):
    """``(doc_id, n, component, kept)`` sorted by repr; nodes are distinct sets."""
    sets = [_set(t, width) for _, t in rows]
    kinds = list(dict.fromkeys(s for s in sets if s))
    root = {s: s for s in kinds}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            same = len(a & b)
            if 100 * same >= 80 * (len(a) + len(b) - same):
                root[find(a)] = find(b)
    low = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            low[find(s)] = min(i, low.get(find(s), i))
    out = []
    for (i, _), s in zip(rows, sets):
        c = low.get(find(s)) if s else i
        out.append((i, len(s), c, c == i))
    return sorted(out, key=repr)


def _got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def _families(rng):
    """Families of drifting copies, texts of one template (alike by 0.5 to 0.8), unrelated ones."""
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(12):
            for _ in range(rng.randrange(0, 4)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    frame = [word() for _ in range(60)]
    texts += [" ".join(frame + [word() for _ in range(rng.randrange(8, 40))]) for _ in range(80)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("broadcast", [True, False])
def test_components_equal_all_pairs(spark, monkeypatch, width, broadcast):
    rng = random.Random(width)
    texts = _families(rng)
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900 + i, texts[i].upper()) for i in range(30)] + [(7, texts[7]), (7, texts[9]), (None, texts[3]), (None, None), (None, "only here and nowhere else at all")]
    rows += [(950, None), (951, ""), (952, " \t\r\n"), (953, "one"), (954, "ONE"), (955, "É é ß a b c d e"), (956, "x\x1cy z"), (957, "a b"), (958, "b a")]
    if not broadcast:
        monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
        monkeypatch.setattr("leafline.llm.shared.BROADCAST_IDS", -1)
    assert _got(minhash.near_duplicates(_frame(spark, rows).repartition(3), width=width)) == _brute(rows, width)


def test_keeping_one_of_each_and_empty_tables(spark):
    none = _frame(spark, [])
    assert minhash.near_duplicates(none, width=2).count() == 0 and minhash.keep_one_of_each(none).count() == 0
    rows = [(3, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (5, None), (6, None), (2, "q"), (8, "q")]
    left = minhash.keep_one_of_each(_frame(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([rows[1], rows[2], rows[3], rows[5]], key=repr)  # 6 is empty as 5 is
    assert left.columns == _frame(spark, rows).columns


def test_a_crowd_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """One group of most rows: pairs that are confirmed grow with the rows, not their square."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        own = list(base)
        for _ in range(4):
            own[rng.randrange(200)] = f"x{i}-{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    asked, plain = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *a: asked.append(pairs.count()) or plain(pairs, *a))
    got = _got(minhash.near_duplicates(_frame(spark, rows), width=2))
    assert {c for _, _, c, _ in got} == {0} and sum(asked) < 20 * len(rows)


@pytest.mark.parametrize("stars", [0, 1])
def test_blocks_of_crowded_keys_lose_no_link(spark, monkeypatch, stars):
    """Copies of one text, alike by 0.6 to 0.9, in blocks of a few sets: stars alone don't link them."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", stars)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 7)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    want = _brute(rows, 2)
    assert _got(minhash.near_duplicates(_frame(spark, rows), width=2)) == want and len({c for _, _, c, _ in want}) > 5


def test_pruning_keeps_to_its_miss_probability():
    """At the wanted similarity a batch prunes a few in a million; nearly all pairs of 0.3 go after the second."""
    need = minhash.fewest_matches(0.8)
    for i, m in enumerate(need):
        n = 64 * (i + 1)
        at = lambda s: sum(comb(n, k) * ((1 + s) / 2) ** k * ((1 - s) / 2) ** (n - k) for k in range(m))  # noqa: E731, B023
        assert at(0.8) < 3e-6 and (i < 1 or at(0.3) > 0.99)
    assert minhash.fewest_matches(0.8, 1e-3) > need


def test_signatures_agree_as_often_as_said():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        agree = []
        for _ in range(40):
            common, own = rng.integers(0, 1 << 64, 400, dtype=np.uint64), rng.integers(0, 1 << 64, 2 * int(400 * (1 / share - 1) / 2), dtype=np.uint64)
            a, b = (minhash.minhashes(np.concatenate([common, x])) for x in np.array_split(own, 2))
            x, y = (np.unpackbits(minhash.signature(m).view(np.uint8)) for m in (a, b))
            agree.append((x == y).mean())
            assert abs((a == b).mean() - share) < 0.15
        assert abs(np.mean(agree) - (1 + share) / 2) < 0.02


def test_near_dedup_goes_by_simhash_first(spark, monkeypatch):
    """Links of the named method are made and confirmed before any band is; wrong groups add none, and the same rows stay."""
    import corpus_pipeline

    from leafline.llm import simhash

    rng = random.Random(9)
    texts = _families(rng)
    rows = list(enumerate(texts)) + [(500 + i, t + " end") for i, t in enumerate(texts[:40])] + [(None, texts[3]), (990, None), (991, " ")]
    docs = _frame(spark, rows)
    want = {r["doc_id"] for r in minhash.keep_one_of_each(docs, width=5, least=0.8).collect()}
    asked, plain = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *a: asked.append((pairs.count(), (out := plain(pairs, *a)).count())) or out)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, width=5).collect()}
    linked = len(groups) - len(set(groups.values()))
    assert linked > 5 and len(asked) > 1 and 0 < asked[0][1] <= asked[0][0] <= len(rows)
    wrong = docs.select("doc_id", F.lit(1).alias("group"))
    assert {r["doc_id"] for r in minhash.keep_one_of_each(docs, width=5, least=0.8, groups=wrong).collect()} == want


def test_links_within_given_groups_miss_nothing(spark, monkeypatch):
    """Where signatures drop most links, those within groups are still all found: not with the first of a group alone, and of every row."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", 20)
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = [(0, "apart from all others in every word")]
    for _ in range(25):
        base = [word() for _ in range(60)]
        other = [*base[:55], *(word() for _ in range(5))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    rows += [(900 + i, t.upper()) for i, t in rows[1:5]]  # equal sets: only the smallest id of them stands for the set
    want = _brute(rows, 5)
    # one group of all; in the second, copies of a set are in their own group with what it links
    own = {r[0]: f"a{(r[0] - 1) // 2}" for r in rows}
    for groups in ({r[0]: "all" for r in rows}, own | {1: "x", 2: "y", 3: "z", 4: "u", 901: "l", 902: "l", 903: "m", 904: "m"}):
        frame = spark.createDataFrame(list(groups.items()), "doc_id long, group string")
        got = _got(minhash.near_duplicates(_frame(spark, rows), width=5, miss=0.9, groups=frame))
        assert got == want and sum(not kept for *_, kept in want) == 29
    assert _got(minhash.near_duplicates(_frame(spark, rows), width=5, miss=0.9)) != want
