"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import release_worker, table_or_shuffle, written

# First code points of Unicode blocks, by script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
NAMES = [*SCRIPTS, "other"]
_FLAT = sorted((lo, hi, i) for i, ranges in enumerate(SCRIPTS.values()) for lo, hi in ranges)
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Words that one Python worker keeps scores of; beyond it starts anew.
CACHE_ENTRIES = 250_000
#: New words that are scored at once.
SCORED = 5000
#: Texts whose words advance together: so many at most, and so many bytes of them for each language; a longer text goes alone.
STEP, TOGETHER = 2000, 1 << 27


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> int:
    p = ord(letter)
    return next((i for lo, hi, i in _FLAT if lo <= p <= hi), len(SCRIPTS))


def script_of(letters: str) -> int:
    """The script of most letters, the first of equals."""
    if letters.isascii():
        return 0
    found = list(map(_script, letters))
    if found.count(found[0]) == len(found):
        return found[0]
    return max(found, key=lambda i: (found.count(i), -i))


def grams(letters: str, longest: int) -> list[str]:
    """Character n-grams of a word with its ends marked, one letter at least."""
    w = f"<{letters}>"
    return [*letters, *[w[i : i + n] for n in range(2, longest + 1) for i in range(len(w) - n + 1)]]


@dataclass
class Model:
    """Per-language scores of n-grams (a row each, the first for unseen ones), and the scripts that each language is written in."""

    langs: list[str]
    row_of: dict[str, int]
    scores: np.ndarray
    scripts: dict[int, np.ndarray]
    longest: int
    penalty: float
    floor: float
    _known: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None
    _letters: np.ndarray | None = None
    _told: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of words (letters only) relative to each one's best language: 0 for it, ``floor`` at least.

        Languages that aren't written in the word's script get the floor; a word in a script of no
        language, or without a letter, says nothing.
        """
        out = np.zeros((len(words), len(self.langs)), np.float32)
        single = {s: int(a.argmax()) for s, a in self.scripts.items() if a.sum() == 1}
        rows: list[int] = []
        ends, at, script = [], [], []
        row_of = self.row_of
        for i, w in enumerate(words):
            if not w or (s := script_of(w)) not in self.scripts:
                continue
            if s in single:
                out[i] = self.floor
                out[i, single[s]] = 0.0
                continue
            rows += [row_of[g] if g in row_of else 0 for g in grams(w, self.longest)]
            ends.append(len(rows))
            at.append(i)
            script.append(s)
        if at:
            total = np.add.reduceat(self.scores[rows], [0, *ends[:-1]], axis=0)
            masks = np.zeros((len(NAMES), len(self.langs)), bool)
            for s, allowed in self.scripts.items():
                masks[s] = allowed
            total = np.where(masks[script], total, -np.inf)
            out[at] = np.maximum(total - total.max(axis=1, keepdims=True), self.floor)
        return out

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of the table of scores for distinct words, new ones being added."""
        known = self._known
        new = [w for w in words if w not in known]
        if new:
            n = len(known)
            if n + len(new) > len(self._table):
                more = max(len(new), len(self._table))
                self._table = np.concatenate([self._table, np.zeros((more, len(self.langs)), np.float32)])
                self._letters = np.concatenate([self._letters, np.zeros(more, np.int32)])
                self._told = np.concatenate([self._told, np.zeros(more, np.int32)])
            lower = [w.lower() for w in new]
            letters = [w if w.isalpha() else "".join(LETTERS.findall(w)) for w in lower]
            for i in range(0, len(new), SCORED):
                self._table[n + i : n + min(i + SCORED, len(new))] = self.score(letters[i : i + SCORED])
            self._letters[n : n + len(new)] = list(map(len, letters))
            self._told[n : n + len(new)] = [len(w) if w and script_of(w) in self.scripts else 0 for w in letters]
            known.update(zip(new, range(n, n + len(new))))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def label(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text: the language of each word (runs between white space) on the best path, and the word's letters."""
        return [(labels, letters) for labels, letters, _ in self._paths(texts)]

    def _paths(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Labels and letters as :meth:`label` gives them, and the letters again, but 0 for words in a script of no language.

        Texts advance together, one word a step, the longest first.
        """
        if self._table is None or len(self._known) > CACHE_ENTRIES:
            self._known = {}
            self._table, self._letters = np.zeros((1024, len(self.langs)), np.float32), np.zeros(1024, np.int32)
            self._told = np.zeros(1024, np.int32)
        words = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        cuts = (words.offsets.to_numpy() - words.offsets[0].as_py()).tolist()
        del words, coded
        spread, known = self._letters[rows], self._told[rows]
        letters = [(spread[a:b], known[a:b]) for a, b in zip(cuts, cuts[1:])]
        kind = np.min_scalar_type(-len(self.langs))  # int8 up to 128 languages
        order = sorted((i for i in range(len(texts)) if cuts[i + 1] > cuts[i]), key=lambda i: cuts[i] - cuts[i + 1])
        out = [(np.empty(0, kind), *x) for x in letters]
        if not order:
            return out
        sizes = np.array([cuts[i + 1] - cuts[i] for i in order])
        steps, n_langs = int(sizes[0]), len(self.langs)
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts with a word at each step
        starts = np.concatenate([[0], np.cumsum(active)])
        stepped = np.empty(starts[-1], np.int32)  # rows of the table by step, then by text
        for rank, i in enumerate(order):
            stepped[starts[: sizes[rank]] + rank] = rows[cuts[i] : cuts[i + 1]]
        del rows
        tops = starts.tolist()
        back = np.empty((tops[-1], n_langs), kind)
        own = np.arange(n_langs, dtype=kind)
        s = self._table[stepped[: tops[1]]]
        finals = np.zeros((len(order), n_langs), np.float32)
        for t in range(1, steps):
            a, b = tops[t], tops[t + 1]
            if b - a < len(s):
                finals[b - a : len(s)] = s[b - a :]
                s = s[: b - a]
            best = s.argmax(axis=1).astype(kind)
            jump = s.max(axis=1)[:, None] - self.penalty
            stay = s >= jump
            back[a:b] = np.where(stay, own, best[:, None])
            s = np.where(stay, s, jump) + self._table[stepped[a:b]]
        finals[: len(s)] = s
        state = finals.argmax(axis=1).astype(kind)
        path = np.empty(tops[-1], kind)
        every = np.arange(len(order))
        for t in range(steps - 1, -1, -1):
            a, b = tops[t], tops[t + 1]
            path[a:b] = state[: b - a]
            if t:
                state[: b - a] = back[a:b][every[: b - a], state[: b - a]]
        for rank, i in enumerate(order):
            out[i] = (path[starts[: sizes[rank]] + rank], *letters[i])
        return out

    def verdict(self, labels: np.ndarray, letters: np.ndarray, told: np.ndarray) -> tuple[str, float]:
        """The language of most letters, the first of equals, and its share of all letters.

        Letters in a script of no language count for none; a text of only such letters gets the language
        of most words on its path, with score 0. Unknown without any letter.
        """
        total = int(letters.sum())
        if not total or not self.langs:
            return UNKNOWN, 0.0
        by = np.bincount(labels, weights=told, minlength=len(self.langs))
        if not by.any():
            return self.langs[int(np.bincount(labels, weights=letters, minlength=len(self.langs)).argmax())], 0.0
        best = int(by.argmax())
        return self.langs[best], float(by[best] / total)

    def verdicts(self, texts: pa.Array) -> list[tuple[str, float]]:
        return [self.verdict(*x) for x in self._paths(texts)] if self.langs else [(UNKNOWN, 0.0)] * len(texts)

    def steps(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Where to cut ``texts``, as starts and lengths, so that the paths of one step fit in memory."""
        most = TOGETHER // max(1, len(self.langs))
        start, held = 0, 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
            if i > start and (i - start == STEP or held + size > most):
                yield start, i - start
                start, held = i, 0
            held += size
        if len(texts) > start:
            yield start, len(texts) - start


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_docs: int = 500,
    longest: int = 3,
    penalty: float = 8.0,
    floor: float = -6.0,
) -> Model:
    """Learn from ``max_docs`` documents of each language at most, the first by a hash of their ids.

    The bound is a parameter: so many documents of each language make the model, which is all that
    the driver holds. All languages and all n-grams of those documents are learned.
    Rows with a null text or language, or a text without a letter, teach nothing; with no row left
    the model knows no language and calls everything unknown.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h")
    )
    counts = written(rows.groupBy("lang").count(), "docs-of-languages")
    n_langs = counts.count()
    if not n_langs:
        return Model([], {}, np.empty((1, 0)), {}, longest, penalty, floor)
    # a first cut by hash leaves about three times the bound, then the first of each language are taken
    share = 3.0 * max_docs / F.col("count")
    few = rows.join(table_or_shuffle(counts), "lang").where((F.col("h").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < share)
    first = few.select("lang", "h", "text").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    sample = first.where(F.col("n") <= max_docs).select("lang", "text").repartition(4 * n_langs)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for pdf in it:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                seen.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        rows = Counter()
        for lang, words in seen.items():
            for w, n in words.items():
                rows[lang, "#" + str(script_of(w))] += n * len(w)
                for g in grams(w, longest):
                    rows[lang, g] += n
        yield pd.DataFrame([(lang, g, n) for (lang, g), n in rows.items()], columns=["lang", "gram", "n"])

    grams_of = sample.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())  # the model has scores of each
    return _model(langs, [(r["lang"], r["gram"], r["n"]) for r in grams_of.collect()], longest, penalty, floor)


def _model(langs: list[str], rows: list[tuple[str, str, int]], longest: int, penalty: float, floor: float) -> Model:
    at = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    scripts = np.zeros((len(langs), len(NAMES)))
    for lang, g, n in rows:
        if g.startswith("#"):
            scripts[at[lang], int(g[1:])] = n
        else:
            counts.setdefault(g, np.zeros(len(langs)))[at[lang]] = n
    total = sum(counts.values(), np.zeros(len(langs)))
    size = max(1, len(counts))
    known = scripts.sum(axis=1) > 0
    used = (scripts >= 0.01 * scripts.sum(axis=1, keepdims=True)) & (scripts > 0) & known[:, None]
    names = sorted(counts)
    seen = np.array([counts[g] for g in names]).reshape(-1, len(langs))
    scores = np.log((np.concatenate([np.zeros((1, len(langs))), seen]) + 0.5) / (total + 0.5 * size))
    allowed = {s: used[:, s] for s in range(len(NAMES)) if used[:, s].any()}
    return Model(langs, {g: i for i, g in enumerate(names, 1)}, scores, allowed, longest, penalty, floor)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row: the language of most letters on the Viterbi path, and its share.

    ``und`` with score 0 if the text is null or has no letter; a text whose letters are all in scripts
    of no known language gets one of them, with score 0. Whole texts are read, whatever their length;
    the model's size is bounded, so it goes to every executor.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        m = shared.value
        for batch in it:
            for start, n in m.steps(batch.column(1)):
                part = batch.slice(start, n)
                said = m.verdicts(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())],
                    names=[id_col, "lang_pred", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, span, start_word, n_words, lang)``: runs of one language in each text, in order.

    Words without a letter, or in a script of no language, go with the run that they stand in; texts
    of nothing else have no span.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        m = shared.value
        for batch in it:
            for start, n in m.steps(batch.column(1)) if m.langs else ():
                part = batch.slice(start, n)
                out: list[tuple] = []
                for row, (labels, _, told) in enumerate(m._paths(part.column(1))):
                    if told.any():
                        firsts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
                        ends = np.append(firsts[1:], len(labels))
                        out += [(row, i, int(a), int(b - a), m.langs[labels[a]]) for i, (a, b) in enumerate(zip(firsts, ends))]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                row, *cols = (pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), *cols], names=[id_col, "span", "start_word", "n_words", "lang"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, span int, start_word long, n_words long, lang string")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """The fold that teaches nothing: crc32 of the id as text is divisible by ``folds``; null is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with a language that holds ``min_score`` of their letters; all columns stay, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        m = shared.value
        for batch in it:
            for start, n in m.steps(batch.column(at)):
                part = batch.slice(start, n)
                said = m.verdicts(part.column(at))
                yield part.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in said], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)
