"""Phrase collocations: words and then frequent phrases are ranked, and neighbours are counted in tiles of pairs of ranks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release_worker, table_or_shuffle, written

BREAK = -1  # the id between pieces, and of words that no frequent phrase can hold
SLICE_DOCS = 256  # documents whose words are in a Python worker's memory at once
WINDOW = 1 << 22  # bytes of text that are split into words at once
WORDS_HELD = 300_000  # words that a task counts before it sends them on
RANKED_WORDS = 500_000  # words with ids of their own
RANKED_PHRASES = 1_000_000  # phrases of a length with ids of their own
LOOKED_UP = 500_000  # rows of a table of phrases that is broadcast
SIDE = 1024  # ranks along a side of a tile
HEAD = 256  # tiles along each side of the square that may have dense tiles
DENSE_FROM = 1 << 15  # pairs at once from which a tile is counted densely
DENSE_TILES = 8  # of a task, of 8 MB each
PENDING = 1 << 20  # pairs before a task counts them
SPARSE_HELD = 1 << 20  # counts of pairs outside dense tiles before a task sends them on
FILTER_BITS = 27  # a bit of so many address bits (16 MB in all) says what may be frequent without a rank

_LOW = bytes.maketrans(b".,;:!?\n\v\f\r\t", b"\xff" * 10 + b" ")


def marked(texts: list[bytes | None]) -> bytes:
    """The texts with A-Z lowered, blanks between words, and the byte 255, which no text holds, as a word between pieces."""
    return b"\xff".join(t for t in texts if t).lower().translate(_LOW).replace(b"\xff", b" \xff ")


def windows(data: bytes) -> Iterator[list[bytes]]:
    """The words, cut at blanks into lists of bounded text."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + WINDOW) if at + WINDOW < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[at:end].split()  # of white space only blanks are left
        at = end


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for i in range(0, batch.num_rows, SLICE_DOCS):
        own: dict[str, list[bytes | None]] = {}
        part = batch.slice(i, SLICE_DOCS)
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            own.setdefault("und" if lang is None else lang, []).append(text)
        for lang, texts in own.items():
            yield lang, marked(texts)


def word_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``(lang, word, f)``, counted within tasks before words are shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        found: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                words.pop(b"\xff", None)
                cols = [pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.binary()).cast(pa.string()), pa.array(words.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "word", "c"])
            found.clear()

        for batch in it:
            for lang, data in _by_lang(batch):
                for words in windows(data):
                    found.setdefault(lang, Counter()).update(words)
                if sum(map(len, found.values())) > WORDS_HELD:
                    yield from out()
        yield from out()

    counted = docs.select(F.col(lang_col).cast("string"), text_col).mapInArrow(batches, "lang string, word string, c long")
    return counted.groupBy("lang", "word").agg(F.sum("c").alias("f"))


def most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """Rows with the largest ``f``, at most ``limit``: all from some f on, found from a histogram of powers of 2 to the 1/16."""
    step = F.floor(F.log2(F.col("f").cast("double")) * 16)
    total, least = 0, None
    for r in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # about a thousand at most
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    return counted.where(F.lit(False) if least is None else step >= least)


class Ranks:
    """Ids of the ranked phrases of one length: pairs of ids of the phrases one word shorter, or none for words."""

    def __init__(self, left: np.ndarray, right: np.ndarray, words: np.ndarray):
        """``words`` has a row for each phrase, the most frequent first; its number is its id."""
        key = (left << 32) | right
        order = np.argsort(key)
        self.keys, self.ids, self.words = key[order], order.astype(np.int32), words

    def without_words(self) -> Ranks:
        """The same for looking up only, as small as can be."""
        out = object.__new__(Ranks)
        out.keys, out.ids, out.words = self.keys, self.ids, None
        return out

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), BREAK, np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        if len(at) and len(self.keys):
            key = (left[at] << 32) | right[at]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[at] = np.where(self.keys[i] == key, self.ids[i], BREAK)
        return out


class PairTiles:
    """Counts of pairs of ids.

    Ids are ranks, so most pairs fall into a few tiles of 1024 x 1024 near the origin: a tile that
    gets many is an array of counts with a cell for each pair, filled by bincount. Pairs of all
    other tiles are sorted coordinates with counts.
    """

    def __init__(self):
        self.pending: list[np.ndarray] = []
        self.n_pending = 0
        self.tiles: dict[int, np.ndarray] = {}
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pending.append((a << 32) | b)
        self.n_pending += len(a)

    def settle(self, room: int) -> None:
        """Count what is pending; at most ``room`` more tiles become dense."""
        if not self.pending:
            return
        key = np.concatenate(self.pending)
        self.pending, self.n_pending = [], 0
        a, b = key >> 32, key & 0xFFFFFFFF
        head = (a | b) < SIDE * HEAD
        tile = ((a[head] // SIDE) * HEAD + b[head] // SIDE).astype(np.uint16)
        size = np.bincount(tile, minlength=HEAD * HEAD)
        dense = [t for t in np.argsort(-size, kind="stable")[:DENSE_TILES].tolist() if size[t] >= DENSE_FROM and (t in self.tiles or (room := room - 1) >= 0)]
        rest = [key[~head]]
        if dense:
            order = np.argsort(tile, kind="stable")
            cell = (((a[head] % SIDE) * SIDE) + b[head] % SIDE)[order]
            end = np.cumsum(size)
            for t in dense:
                counts = np.bincount(cell[end[t] - size[t] : end[t]], minlength=SIDE * SIDE)
                self.tiles[t] = self.tiles[t] + counts if t in self.tiles else counts
            rest.append(key[head][~np.isin(tile, dense)])
        else:
            rest.append(key[head])
        keys, counts = np.unique(np.concatenate(rest), return_counts=True)
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys, self.counts = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts

    def out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs and their counts so far, which are then forgotten."""
        keys, counts = [self.keys], [self.counts]
        for t, tile in self.tiles.items():
            cell = np.flatnonzero(tile)
            keys.append(((t // HEAD * SIDE + cell // SIDE) << 32) | (t % HEAD * SIDE + cell % SIDE))
            counts.append(tile[cell])
        self.__init__()
        key = np.concatenate(keys)
        return key >> 32, key & 0xFFFFFFFF, np.concatenate(counts)


def _salted(word: bytes, salt: int) -> int:
    """An id below BREAK for a word without a rank."""
    return -2 - (xxhash.xxh64_intdigest(b"%d " % salt + word, 42) >> 2)


def _salt(unranked: DataFrame) -> int:
    """A salt under which no two words of a language share an id: checked on all of them."""
    for salt in range(100):
        own = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{salt} "), "word")), 2)
        if unranked.groupBy("lang", own.alias("h")).count().where("count > 1").isEmpty():
            return salt
    raise RuntimeError("no salt keeps words apart")


def _places(words: np.ndarray) -> np.ndarray:
    """For each row of word ids, the bit of a filter that stands for it."""
    h = np.zeros(len(words), np.uint64)
    for col in words.T:
        h = (h ^ col.astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(64 - FILTER_BITS)).view(np.int64)


def _in_filter(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = _places(words)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter(phrases: DataFrame, levels=None) -> np.ndarray:
    """Bits of the phrases ``(lang, w)`` without a rank in ``levels``, a broadcast; of all without it. It is of one size, whatever there is."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            if not batch.num_rows:
                continue
            langs, w = np.array(batch.column(0).to_pylist(), object), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            left = np.ones(len(w), bool)
            if levels is not None:
                for lang in set(langs.tolist()):
                    mine = langs == lang
                    left[mine] = _ranks_of(w[mine], levels.value.get(lang, [])) < 0
            yield pa.RecordBatch.from_arrays([pa.array(_places(w[left]))], names=["place"])

    places = phrases.select("lang", "w").mapInArrow(batches, "place long")
    block = F.call_function("shiftright", F.col("place"), F.lit(15))
    rows = places.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(0x7FFF))).alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for i, raw in zip(rows.column("block").to_pylist(), rows.column("bits").to_pylist()):
        out[i * 4096 : (i + 1) * 4096] = np.frombuffer(raw, np.uint8)
    return out


def _ranks_of(words: np.ndarray, levels: list[Ranks]) -> np.ndarray:
    """The ids of phrases of as many words as there are columns, from the ``levels`` of 2, 3 .. words; BREAK for those without one."""
    cols = list(words.T)
    for ranks in levels[: len(cols) - 1]:
        cols = [ranks.of(a, b) for a, b in zip(cols, cols[1:])]
    return cols[0] if len(cols) == 1 else np.full(len(words), BREAK, np.int64)


def _coded(docs: DataFrame, lang_col: str, text_col: str, ids, salt: int | None, bits=None) -> DataFrame:
    """``(lang, ids)``: the word ids of some documents each, a BREAK between pieces. ``ids``: a broadcast of lang to word to id.

    Words that aren't frequent are a BREAK too. With a ``salt``, frequent words without a rank have an
    id by their hash; ``bits``, a broadcast filter, says which words may be such.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            for lang, data in _by_lang(batch):
                known = ids.value.get(lang, {})
                if salt is None:
                    coded = [np.fromiter(map(known.get, words, repeat(BREAK)), np.int64, len(words)) for words in windows(data)]
                else:
                    coded = [np.array([BREAK if w == b"\xff" else i if (i := known.get(w)) is not None else _salted(w, salt) for w in words], np.int64) for words in windows(data)]
                x = np.concatenate([*coded, np.empty(0, np.int64)])
                if salt is not None:
                    other = np.flatnonzero(x < BREAK)
                    x[other[~_in_filter(bits.value, x[other, None])]] = BREAK
                alone = x == BREAK  # a run of them says no more than one
                x = x[~(alone & np.concatenate([[True], alone[:-1]])[: len(x)])]
                x = x.astype(np.int32) if salt is None else x
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([x.tobytes()], pa.binary())], names=["lang", "ids"])

    return docs.select(F.col(lang_col).cast("string"), text_col).mapInArrow(batches, "lang string, ids binary")


def _phrases(coded: DataFrame, length: int, levels, whole: list[bool], narrow: bool, bits=None) -> DataFrame:
    """``(lang, key, f)`` with the pairs of ids, ``key``, of ``length`` words each. ``levels``: a broadcast of lang to Ranks of 2, 3 .. words.

    ``whole`` says of each shorter length, from 1, whether all frequent phrases have ranks. If so,
    only neighbours of ranked phrases are counted, in tiles; else there is ``w`` too: others are counted as the
    words they are, so that none is lost, but for those that a part says can't be frequent. ``bits`` is
    a broadcast filter of the frequent phrases one word shorter that have no rank.
    """
    n = length - 1
    all_ranked = all(whole[:n])
    names = ["lang", "key", "c"] if all_ranked else ["lang", "key", "w", "c"]

    def rows(lang: str, key: np.ndarray | None, w: np.ndarray | None, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(c), 1 << 18):
            m = min(1 << 18, len(c) - i)
            cols = [pa.array([lang] * m, pa.string()), pa.nulls(m, pa.int64()) if key is None else pa.array(key[i : i + m])]
            if not all_ranked:
                lists = pa.list_(pa.int64())
                cols.append(pa.nulls(m, lists) if w is None else pa.FixedSizeListArray.from_arrays(pa.array(w[i : i + m].ravel()), length).cast(lists))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(c[i : i + m])], names=names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        tiles: dict[str, PairTiles] = {}

        def settled() -> None:
            for t in tiles.values():
                t.settle(DENSE_TILES - sum(len(x.tiles) for x in tiles.values()))

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in tiles.items():
                a, b, c = own.out()
                yield from rows(lang, (a << 32) | b, None, c)

        for batch in it:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.int32 if narrow else np.int64).astype(np.int64)
                if len(x) < length:
                    continue
                own = x
                for ranks in levels.value.get(lang, [])[: n - 1]:
                    own = ranks.of(own[:-1], own[1:])
                if len(own) != len(x) - n + 1:  # a language without ranks
                    own = np.full(len(x) - n + 1, BREAK, np.int64)
                a, b = own[:-1], own[1:]
                both = (a >= 0) & (b >= 0)
                tiles.setdefault(lang, PairTiles()).add(a[both], b[both])
                if not all_ranked:
                    ends = len(x) - n
                    at = np.flatnonzero(~both & reduce(np.logical_and, [x[i : i + ends] != BREAK for i in range(length)]))
                    for part in (0, 1) if n > 1 else ():  # of single words only those that may be frequent have an id
                        known = own[at + part] >= 0
                        known[~known] = _in_filter(bits.value, x[at[~known, None] + part + np.arange(n)])
                        at = at[known]
                    if len(at):
                        w, c = np.unique(x[at[:, None] + np.arange(length)], axis=0, return_counts=True)
                        yield from rows(lang, None, w, c)
                if sum(t.n_pending for t in tiles.values()) > PENDING:
                    settled()
                    if sum(len(t.keys) for t in tiles.values()) > SPARSE_HELD:
                        yield from out()
        settled()
        yield from out()

    counted = coded.mapInArrow(batches, "lang string, key long, c long" if all_ranked else "lang string, key long, w array<long>, c long")
    # tasks have counted before: hash tables of nearly all pairs of a task would only fill an executor's memory
    return counted.repartition(*names[:-1]).groupBy(*names[:-1]).agg(F.sum("c").alias("f"))


def _worded(counted: DataFrame, length: int, before) -> DataFrame:
    """``(lang, w, f)``: the counted phrases with the ids of their words. ``before``: a broadcast of lang to the words of the ranked phrases one word shorter."""
    n = length - 1

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for batch in it:
            langs, key = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            w = np.empty((batch.num_rows, length), np.int64)
            plain = key.is_null().to_numpy(zero_copy_only=False)
            if plain.any():
                w[plain] = batch.column(3).filter(key.is_null()).flatten().to_numpy().reshape(-1, length)
            key = key.fill_null(0).to_numpy()
            a, b = key >> 32, key & 0xFFFFFFFF
            for lang in set(langs[~plain].tolist()):
                mine = ~plain & (langs == lang)
                if n == 1:
                    w[mine] = np.stack([a[mine], b[mine]], axis=1)
                else:
                    words = before.value[lang]
                    w[mine] = np.concatenate([words[a[mine]], words[b[mine], -1:]], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), length).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["lang", "w", "f"])

    cols = ["lang", "key", "f", *(["w"] if "w" in counted.columns else [])]
    return counted.select(cols).mapInArrow(batches, "lang string, w array<long>, f long")


def _ranked(found: DataFrame, length: int, before: dict[str, list[Ranks]]) -> tuple[dict[str, Ranks], int]:
    """Ranks of the most frequent phrases, and how many have one."""
    own = most_frequent(found, RANKED_PHRASES).select("lang", "f", *(F.col("w")[i].alias(f"w{i}") for i in range(length))).toArrow().to_pandas()
    out, n = {}, 0
    for lang, rows in own.groupby("lang"):
        words = rows[[f"w{i}" for i in range(length)]].to_numpy(np.int64)
        words = words[np.lexsort((*words.T[::-1], -rows["f"].to_numpy()))]
        cols = list(words.T)
        for ranks in before.get(lang, [])[: length - 2]:
            cols = [ranks.of(a, b) for a, b in zip(cols, cols[1:])]
        if len(cols) != 2:
            continue
        known = (cols[0] >= 0) & (cols[1] >= 0)
        out[lang] = Ranks(cols[0][known], cols[1][known], words[known])
        n += int(known.sum())
    return out, n


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4) -> tuple[DataFrame, list[DataFrame]]:
    """Word counts ``(lang, word, f)``, and for each length from 1 a written table of the phrases that occur ``least`` times.

    ``(lang, w, phrase, last, f, firsts, rests)``: ``w`` holds word ids, ``last`` the last word,
    ``firsts[k - 1]`` and ``rests[k - 1]`` how often the first ``k`` words and the rest occur. Both
    parts occur at least as often as the phrase, so all that is looked up is there.
    """
    spark = docs.sparkSession
    words = written(word_counts(docs, lang_col, text_col), "word-counts")
    often = words.where(F.col("f") >= least)
    own = most_frequent(often, RANKED_WORDS).toArrow().to_pandas().sort_values(["lang", "f", "word"], ascending=[True, False, True])
    own["id"] = own.groupby("lang").cumcount()
    whole = [often.count() == len(own)]
    known = {lang: dict(zip((w.encode() for w in rows["word"]), rows["id"].tolist())) for lang, rows in own.groupby("lang")}
    ids = spark.sparkContext.broadcast(known)
    single = spark.createDataFrame(pa.table({c: pa.array(own[c], t) for c, t in (("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("id", pa.int64()))}))
    salt, bits = None, None
    if not whole[0]:
        others = written(words.join(written(single, "ranked-words").select("lang", "word"), ["lang", "word"], "left_anti"), "other-words")
        salt = _salt(others)
        hashed = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{salt} "), "word")), 2)
        frequent = others.where(F.col("f") >= least).select("lang", "word", "f", (F.lit(-2) - hashed).alias("id"))
        bits = spark.sparkContext.broadcast(_filter(frequent.select("lang", F.array("id").alias("w"))))
        single = single.union(frequent)
    none = F.array().cast("array<long>")
    single = single.select("lang", F.array("id").alias("w"), F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("firsts"), none.alias("rests"))
    tables = [written(single, "phrases-1")]
    coded = written(_coded(docs, lang_col, text_col, ids, salt, bits), "coded-words")
    ids.unpersist()
    levels: dict[str, list[Ranks]] = {}
    for length in range(2, longest + 1):
        told = [
            spark.sparkContext.broadcast({lang: [r.without_words() for r in own] for lang, own in levels.items()}),
            spark.sparkContext.broadcast({lang: own[length - 3].words for lang, own in levels.items() if 2 < length < len(own) + 3}),
            *([] if bits is None else [bits]),
        ]
        counted = _phrases(coded, length, told[0], whole, salt is None, bits).where(F.col("f") >= least)
        found, bits = written(_worded(counted, length, told[1]), f"counts-{length}"), None
        for x in told:
            x.unpersist()
        before = table_or_shuffle(tables[-1], LOOKED_UP)
        left = before.select("lang", F.col("w").alias("lw"), F.col("phrase").alias("lp"), F.col("f").alias("lf"), F.col("firsts"))
        right = before.select("lang", F.col("w").alias("rw"), "last", F.col("f").alias("rf"), "rests")
        both = found.withColumn("lw", F.slice("w", 1, length - 1)).withColumn("rw", F.slice("w", 2, length - 1)).join(left, ["lang", "lw"]).join(right, ["lang", "rw"])
        tables.append(written(both.select(
            "lang", "w", F.concat("lp", F.lit(" "), "last").alias("phrase"), "last", "f",
            F.concat("firsts", F.array("lf")).alias("firsts"), F.concat(F.array("rf"), "rests").alias("rests"),
        ), f"phrases-{length}"))
        if length < longest:
            ranked, n = _ranked(found, length, levels)
            whole.append(found.count() == n)
            for lang, ranks in ranked.items():
                levels.setdefault(lang, []).append(ranks)
            if not all(whole):
                told = spark.sparkContext.broadcast({lang: [r.without_words() for r in own] for lang, own in levels.items()})
                bits = spark.sparkContext.broadcast(_filter(found, told))
                told.unpersist()
    return words, tables


def score(phrases: DataFrame) -> DataFrame:
    """``(lang, w, phrase, a, l, r, score)``: of all cuts of a phrase the one of the lowest score, then of the fewest first words."""
    of = F.expr("cast(cast(f as decimal(19,0)) * 2000000 div (cast(firsts[i] as decimal(19,0)) + cast(rests[i] as decimal(19,0))) as long)")
    cuts = phrases.select("lang", "w", "phrase", F.col("f"), "firsts", "rests", F.posexplode("firsts").alias("i", "l"))
    cuts = cuts.select("lang", "w", "phrase", F.col("f").alias("a"), "l", F.col("rests")[F.col("i")].alias("r"), of.alias("score"), "i")
    best = cuts.groupBy("lang", "w", "phrase", "a").agg(F.min(F.struct("score", "i", "l", "r")).alias("x"))
    return best.select("lang", "w", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of 2 to ``longest`` words.

    Words are those between blanks and tabs in pieces that end at ``. , ; : ! ?`` and line ends, with
    A-Z lowered. A phrase must occur ``least`` times; its score is that of its weakest cut, 2a / (l + r)
    in millionths. One within a longer such phrase that occurs ``covered`` percent as often is
    dropped. Best first; ties by a, then by the phrase's bytes. A null language is ``und``; a null or
    empty text has no words; repeated rows count each time; no frequent phrase gives no row.

    Words are ranked by frequency, and neighbours counted as pairs of ranks, in dense tiles near the
    origin and as sorted coordinates elsewhere. Frequent pairs are ranked in turn: neighbouring pairs
    are phrases of three words, those of them phrases of four. At most ``RANKED_WORDS`` words and
    ``RANKED_PHRASES`` phrases have ranks; any others are counted as the words they are, if a filter of
    fixed size doesn't rule out that their parts are frequent.
    """
    words, tables = frequent_phrases(docs, lang_col, text_col, least, longest)
    phrases = reduce(DataFrame.union, tables[1:])
    parts = []
    for length, df in enumerate(tables[2:], 3):
        inside = [F.slice("w", i + 1, m) for m in range(2, length) for i in range(length - m + 1)]
        parts.append(df.select("lang", "f", F.explode(F.array(*inside)).alias("w")))
    scored = score(phrases)
    if parts:
        within = reduce(DataFrame.union, parts).groupBy("lang", "w").agg(F.max("f").alias("longer"))
        scored = scored.join(within, ["lang", "w"], "left").where("longer is null or cast(longer as decimal(38,0)) * 100 < cast(a as decimal(38,0)) * " + str(int(covered)))
    # the best of each of 64 parts of a language first, so that no task sorts all phrases of one
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    ranked = scored
    for by in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        ranked = ranked.withColumn("rank", rank).where(F.col("rank") <= top)
    total = table_or_shuffle(written(words.groupBy("lang").agg(F.sum("f").alias("n")), "words-of-languages"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score").withColumn("rank", F.col("rank").cast("long"))

