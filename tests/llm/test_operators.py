"""Each corpus operator against brute force, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import base64
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from leafline.llm import ann, chats, decontaminate, html_text, langid, licenses, prefix_bpe, simhash, token_files, url_lists
from leafline.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, ids string, counts string, fp string"
ODD = ["", None, " ", "a", "The cat sat.\nOn  the mat \n\n", "x\t y\r\n z", "naïve café's 123 !!", "日本語 テキスト", "a " * 3000, "b" * 3000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "x", "x", "x") for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_files.round_trip(odd, path, 2).collect()}
    start = 0
    for i, t in enumerate(ODD):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids)) and got[i]["ids"] == ids.tobytes(), repr(t)
        start += len(ids)
    assert token_files.round_trip(none, path, 2).count() == 0


def test_huffman_lengths():
    rng = np.random.default_rng(0)
    counts = rng.zipf(1.3, 300).astype(np.int64) % 10**6 + 1
    for longest in (9, 12, 18):
        lengths = token_files.code_lengths(counts, longest)
        assert lengths.max() <= longest and (0.5**lengths).sum() == pytest.approx(1)
    code = token_files.Code(np.arange(300), lengths)
    codes, sizes = code.of_token()
    ids = rng.integers(0, 300, 5000)
    parts = np.array([0, 1, 700, 4299])
    data, _, at = token_files.pack_bits(ids, parts, codes, sizes)
    tops = np.concatenate([[0], np.cumsum(parts)])
    checks = np.concatenate([at[a:b : token_files.EVERY] for a, b in zip(tops, tops[1:])])
    back = token_files.unpack_bits(data.tobytes(), checks, token_files._stretches(parts), code.table(), code.longest)
    assert (back == ids).all()


def test_prefix_bpe(spark, odd, none):
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coded = prefix_bpe.encode_documents(odd, path, pattern)
    for r in prefix_bpe.decode_documents(coded, path, pattern).collect():
        text = ODD[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text), repr(text)
        assert bytes(r["decoded"]) == text.encode()
    assert prefix_bpe.encode_documents(none, path, pattern).count() == 0
    one = {r["doc_id"]: tuple(r) for r in prefix_bpe.round_trip(odd, path, pattern).collect()}
    assert one == {r["doc_id"]: tuple(r) for r in prefix_bpe.decode_documents(coded, path, pattern).collect()}
    assert prefix_bpe.round_trip(none, path, pattern).count() == 0


def test_prefixes_append_and_edit():
    ranks = prefix_bpe.Ranks.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    data = b"internationalisation"
    grown = prefix_bpe.Prefixes(ranks)
    for i in range(len(data)):
        grown.append(data[i : i + 1])
        assert grown.tokens() == ranks.merged(data[: i + 1])
    assert grown.edit(5, 8, b"xyz").tokens() == ranks.merged(data[:5] + b"xyz" + data[8:])


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, block string")


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    rows += [(600, None, 0, "", ""), (601, [0.0] * 16, 0, "", ""), (602, [None] * 16, 0, "", ""), (603, [float("nan")] * 16, 0, "", ""), (604, [1.0], 0, "", "")]
    got = ann.nearest(_vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10).toPandas()
    hits = 0
    for q in range(0, 600, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.array_equal(own["score"], s[own["vec_id"]])
        hits += len(set(want) & set(own["vec_id"]))
    assert hits / 300 >= 0.9 and set(got.query_id) == set(range(0, 600, 20))
    assert ann.nearest(_vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(_vectors(spark, rows[:3]), F.col("vec_id") == 0, k=10).count() == 2


def test_chi_square_quantile():
    assert ann.chi_square_quantile(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert ann.chi_square_quantile(0.95, 16) == pytest.approx(26.296, abs=1e-3)


def test_licenses(spark, odd, none):
    rows = [(100, "Text.\nReleased under the MIT License.\nMore."), (101, licenses.TEMPLATES["ISC"][0]), (102, "Released MIT"), (103, "Nothing here at all")]
    docs = odd.union(spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], DOCS))
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan(docs).collect()}
    assert got == {(100, "MIT"): 1.0, (101, "ISC"): 1.0}
    forms = [(name, text) for name, own in licenses.TEMPLATES.items() for text in own]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(forms)], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licenses.scan(docs).collect()}
    assert all(got[i, name] == 1.0 for i, (name, _) in enumerate(forms))
    assert {i for i, name in got if name != forms[i][0] and got[i, name] == 1.0} == set()
    assert licenses.scan(none).count() == 0


def _lang_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_language_id(spark, small, odd, none):
    docs = _lang_docs(spark, small)
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, model).join(docs, "doc_id").where(langid.held_out()).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()
    said = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert all(said[i]["lang_pred"] == "und" for i in (0, 1, 2)) and said[4]["lang_pred"] == "en" and len(said) == len(ODD)
    de = docs.where("lang = 'de'").first()["text"].replace("\n", " ")[:600]
    fr = docs.where("lang = 'fr'").first()["text"].replace("\n", " ")[:600]
    mixed = spark.createDataFrame([(1, f"{de} {fr}")], "doc_id long, text string")
    assert [r["lang"] for r in langid.spans(mixed, model).orderBy("span").collect()] == ["de", "fr"]
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2})
    assert langid.predict(none, model).count() == 0
    assert langid.predict(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


def test_one_path_at_a_time_equals_many(spark, small):
    docs = [r["text"] for r in _lang_docs(spark, small).limit(40).collect()]
    import pyarrow as pa

    model = langid.fit(_lang_docs(spark, small))
    many = model.label(pa.array(docs))
    for text, (labels, _) in zip(docs, many):
        assert (model.label(pa.array([text]))[0][0] == labels).all()


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (4, 0, "user", "hi"), (4, 1, "assistant", None), (5, 0, None, "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["conv_id"]: r["chat"] for r in chats.render(turns).collect()}
    assert set(got) == {1, 4, 5} and got[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert chats.render(turns.where("false")).count() == 0


def test_url_lists(spark):
    caps = spark.createDataFrame(
        [(1, "http://a.b.com/x", "2023-01-05"), (2, "http://a.b.com/x", "2023-02-05"), (3, "http://u@B.com:80/", "2023-01-05"), (4, None, "2023-01-05"), (5, "nope", None)],
        "page_id long, url string, d string",
    ).select("page_id", "url", F.to_date("d").alias("fetched_on"), F.lit(0).alias("salts"))
    changes = spark.createDataFrame(
        [("b.com", "2023-01-01", True), ("b.com", "2023-02-01", False), ("a.b.com", "2023-02-05", True), (None, "2023-01-01", True)], "domain string, d string, listed boolean"
    ).select("domain", F.to_date("d").alias("listed_on"), "listed")
    got = {r["page_id"]: (r["blocked"], r["n_entries"], r["matched"]) for r in url_lists.judge(caps, changes).collect()}
    assert got == {1: (True, 1, "b.com"), 2: (True, 1, "a.b.com"), 3: (True, 1, "b.com"), 4: (False, 0, None), 5: (False, 0, None)}
    address = spark.createDataFrame([(1, "http://10.0.0.1/x"), (2, "http://10.0.0.1:80/"), (3, "http://[2001:DB8::1]:80/x")], "page_id long, url string")
    address = address.withColumn("fetched_on", F.to_date(F.lit("2023-01-05")))
    listed = spark.createDataFrame([("0.1",), ("[2001:db8::1]",)], "domain string").withColumn("listed_on", F.to_date(F.lit("2023-01-01"))).withColumn("listed", F.lit(True))
    assert {r["page_id"] for r in url_lists.judge(address, listed).where("blocked").collect()} == {3}
    assert url_lists.judge(caps.where("false"), changes).count() == 0
    assert url_lists.judge(caps, changes.where("false")).where("blocked").count() == 0


def test_decontamination(spark, odd, none):
    item = " ".join(f"w{i}" for i in range(24))
    near = item.replace("w23", "zz")
    far = item.replace("w5 ", "qq ").replace("w15 ", "qq ")
    rows = [(100, "lead in " + item.upper() + ". and out"), (101, near), (102, far), (103, "three word item"), (104, "a three word item")]
    docs = odd.union(spark.createDataFrame([(i, t, "", "", "", "") for i, t in rows], DOCS))
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "Three word item!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_shared"] for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(100, 1): 20, (101, 1): 19, (103, 4): 1}
    kept = decontaminate.without_benchmark(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 2
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(docs, items.where("false")).count() == 0


PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
<div class="cookie-notice">We use cookies, really, many, of them.</div><div id="main"><div class="post"><h1>Title</h1><p>First, with&nbsp;a &amp; and
  spaces, commas, and a length that makes it the best container here.<p>Second &lt;one&gt;, also, long enough to count for something.</div></div>
<aside>side</aside><div class="comments"><p>I, as a reader, comment, a lot, on this.</p></div><form><p>Sign up</p></form><script>var a = "<p>no</p>";</script>
<footer>&copy; foot</footer></body></html>"""


def test_html_text(spark):
    assert html_text.main_text(PAGE) == "Title\nFirst, with a & and spaces, commas, and a length that makes it the best container here.\nSecond <one>, also, long enough to count for something."
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, "u", "", "x"), (4, None, "<p>unclosed <b>bold<br>text", "x"), (5, "u", "plain", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4] == ("unclosed bold text", 18) and got[5] == ("plain", 5)
    assert html_text.extract(pages.where("false")).count() == 0


def test_simhash_equals_brute_force(spark, small, odd, none):
    docs = _lang_docs(spark, small).select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    word = re.compile("[^\x20\x09-\x0d]+")
    for i in list(texts)[:20]:
        w = word.findall(texts[i].lower()) if texts[i] and texts[i].isascii() else None
        if w and len(w) > 3:
            hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)]
            assert fps[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}
    kept = simhash.keep_one_of_each(docs)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if find(i) == i}
    assert simhash.near_duplicates(none).count() == 0
    whole = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert simhash.near_duplicates(whole).count() == 3


@pytest.mark.parametrize("crowded", [1, 30, 2000])
def test_crowded_simhash_keys_lose_no_pair(spark, crowded):
    """Fingerprints that share 40 or 50 of their bits crowd the keys; the pairs are those of brute force."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ rng.getrandbits(14) << 7 for _ in range(150)} | {base ^ rng.getrandbits(24) << 40 for _ in range(150)}
    fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for f in list(fps)[:100]}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b, n) for i, a in enumerate(signed) for b in signed[i + 1 :] if (n := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 2}
    got = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), crowded=crowded).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_dedup_stage_finds_every_near_copy(spark):
    """Groups by Jaccard 0.8 of five-word shingles, with chains, a crowded common passage and borderline copies, against brute force."""
    import corpus_pipeline

    from leafline.llm import near_copies

    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for k in range(12):
        text = [rng.choice(words) for _ in range(150)] + passage * (k % 2)
        for n in range(8):
            texts.append(" ".join(text))
            text = list(text) if n % 3 else text
            for _ in range(n % 4 + 1):
                text[rng.randrange(len(text))] = rng.choice(words)
    texts += [texts[5], "one two", "One two", "one two three four five", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) == i}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    got = {r["doc_id"]: r["component"] for r in near_copies.components(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and 12 < len(want) < 90


def test_token_files_keep_added_tokens(spark):
    """The strings of added tokens are their ids, as the library gives them without any setting."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    token = next(iter(tk.get_added_tokens_decoder().values())).content
    texts = [f"end {token} start", "plain words\nhere", f"{token}", f"a{token}{token}\n\n  b", None, token[:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in token_files.round_trip(docs, path, 2).collect()}
    assert got == {i: np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in enumerate(texts)}


def test_scripts_of_no_language_are_no_evidence(spark, small):
    docs = _lang_docs(spark, small)
    model = langid.fit(docs)
    de = docs.where("lang = 'de'").first()["text"].replace("\n", " ")[:200]
    russian = "Все счастливые семьи похожи друг на друга"
    texts = [russian, "日本語 テキスト", f"{russian} " * 20 + de, f"{de} {russian}"]
    new = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(new, model).collect()}
    assert all(said[i][0] in model.langs and said[i][1] == 0.0 for i in (0, 1)) and said[2][1] < 0.5 and said[3][0] == "de" and 0.5 < said[3][1] < 1
    assert {r["doc_id"] for r in langid.accepted(new, model).collect()} == {3}
    assert {r["doc_id"] for r in langid.spans(new, model).collect()} == {2, 3}


def test_more_languages_than_a_byte_counts(spark):
    """Each language has a letter of its own, so every text must come back as its own language."""
    texts = [(i, f"l{i:03}", " ".join([chr(0x4E00 + i) * 3] * 4)) for i in range(210)]
    model = langid._model([r[1] for r in texts], [x for _, lang, t in texts for x in ((lang, f"#{langid.NAMES.index('han')}", 12), (lang, t[0], 12))], 3, 8.0, -6.0)
    import pyarrow as pa

    assert [lang for lang, _ in model.verdicts(pa.array([r[2] for r in texts]))] == [r[1] for r in texts]
    assert [int(x[0][0]) for x in model.label(pa.array([r[2] for r in texts]))] == list(range(len(texts)))
    docs = spark.createDataFrame([(i, lang, t) for i, lang, t in texts], "doc_id long, lang string, text string")
    assert langid.fit(docs).langs == sorted(r[1] for r in texts)


def test_licenses_over_several_lines(spark):
    """Licence texts in paragraphs or wrapped lines inside longer documents, with any line ends; runs equal brute force."""
    import textwrap

    def laid_out(name, *cuts):
        text, parts = licenses.TEMPLATES[name][-1], []
        for c in cuts:
            head, text = text.split(c, 1)
            parts.append(head)
            text = c + text
        return "\n\n".join("\n".join(textwrap.wrap(p, 70)) for p in [*parts, text])

    around = "\n".join(f"line {i} of some longer document about thing {i * i}" for i in range(40))
    whole = {
        "MIT": laid_out("MIT", "The above copyright", "THE SOFTWARE IS"),
        "Apache-2.0": laid_out("Apache-2.0", "You may obtain", "Unless required"),
        "GPL-3.0": laid_out("GPL-3.0", "This program is distributed"),
        "Zlib": laid_out("Zlib", "Permission is granted", "1. The", "2. Altered", "3. This"),
        "BSL-1.0": laid_out("BSL-1.0", "The copyright notices", "THE SOFTWARE IS"),
        "BSD-3-Clause": "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file",
    }
    rows = [(name, end) for name in whole for end in ("\n", "\r\n", "\r")]
    texts = [f"{around}\n{whole[name]}\n{around}".replace("\n", end) for name, end in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in licenses.scan(docs).collect()}
    assert {(i, name) for i, (name, _) in enumerate(rows)} <= set(got)
    assert all(got[i, name] == (1.0, 1) for i, (name, _) in enumerate(rows))
    scanner, rng = licenses.Scanner.of(licenses.TEMPLATES, 0.8), random.Random(1)
    for _ in range(30):
        words = rng.choice(licenses.TEMPLATES[rng.choice(sorted(whole))]).split()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = "changed"
        lines, at = ["before this", ""], 0
        while at < len(words):
            step = rng.randrange(1, 14)
            lines += [" ".join(words[at : at + step])] + [""] * rng.randrange(2)
            at += step
        lines += lines[3:5] + ["after that"]
        best = {}
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                for k, score in scanner.unit("\n".join(lines[a : b + 1])).items():
                    name = scanner.templates[k][0]
                    best[name] = max(best.get(name, 0), score)
        assert {k: x[0] for k, x in scanner.runs("\n".join(lines)).items()} == best
