"""Byte-level BPE by prefix dynamic programming, in Spark tasks.

Every prefix of a byte string has one valid last token: the token that ends the encoding of that
prefix. Storing it for each prefix makes an append exact (only new prefixes are worked out) and
lets an edit keep all prefixes but those near it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import held_by_worker
from .words import WordTable

#: Entries that one Python worker keeps of words, pieces and pairs it has seen; beyond it starts anew.
CACHE_ENTRIES = 250_000
#: Rows that a task encodes and hands on at once.
STEP = 250


class Ranks:
    """A rank file: token bytes to id, lower ids merging first, and which neighbours can stand together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.longest = max(map(len, ranks), default=1)
        #: All tokens that end at each byte, the longest first; bytes stand as characters.
        self.ends = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
        self.ends.make_automaton()
        self._own: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}

    @classmethod
    def from_file(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """Plain merging of a short byte string, lowest rank first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ids[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        if (known := self._own.get(token)) is None:
            known = self._own[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether the bytes of both encode to exactly these two."""
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > CACHE_ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class Prefixes:
    """The last token of each prefix of a growing byte string (one piece of a text)."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Add bytes; what is stored for earlier prefixes stays as it is."""
        return self._extend(more, [])

    def edit(self, start: int, stop: int, new: bytes) -> Prefixes:
        """Replace ``data[start:stop]``; only prefixes near the edit are worked out again.

        What holds for a prefix follows from the bytes and the stored tokens within the longest
        token's length before it. So once that many in a row, past the edit, are as they were, all
        later ones are too.
        """
        tail, known = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        return self._extend(new + tail, known)

    def _extend(self, more: bytes, known: list[int]) -> Prefixes:
        """Add bytes, of which the last ended in the tokens ``known`` in another text."""
        last, stands, fit = self.last, self.ranks.stands, self.ranks.fit
        start, self.data = len(last), self.data + more
        text = self.data.decode("latin-1")
        since, same = len(text) - len(known), 0
        for at, (token, size) in self.ranks.ends.iter(text, max(0, start - self.ranks.longest + 1)) if more else ():
            # the first token that holds is the only one that can
            if at == len(last) and stands(token) and (size > at or fit(last[at - size], token)):
                last.append(token)
                if at >= since:
                    same = same + 1 if token == known[at - since] else 0
                    if same == self.ranks.longest:
                        last += known[at - since + 1 :]
                        break
        if len(last) < len(text):
            raise ValueError(f"no token ends the prefix of {len(last) + 1} bytes; the ranks lack a single byte")
        return self

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.ranks.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts: pieces of the pattern, each encoded by its prefixes; words seen before are looked up."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self._piece: dict[str, bytes] = {}
        self.words = WordTable(lambda words: list(map(self._encoded, words)), self._encoded, CACHE_ENTRIES)

    def _encoded(self, text: str) -> bytes:
        out = []
        for piece in self.pieces.findall(text):
            if (packed := self._piece.get(piece)) is None:
                tokens = Prefixes(self.ranks, piece.encode()).tokens()
                packed = np.array(tokens, "<u4").tobytes()
                if len(piece) <= 64:
                    if len(self._piece) > CACHE_ENTRIES:
                        self._piece.clear()
                    self._piece[piece] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.words.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each Python worker; its caches serve all tasks there."""
    return held_by_worker(("prefix_bpe", path, pattern), lambda: Encoder(Ranks.from_file(path), pattern))


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_tokens, ids)``: each whole text's token ids, packed as little-endian unsigned 32-bit integers.

    The rank file is read on the executors from ``ranks_path``. Null counts as empty, which has no
    ids; every row gives a row, so repeated ids and null ids stay. Nothing is shuffled. Words are looked
    up in a table of those seen before, which is right only for a ``pattern`` that cuts a text at a blank
    after a visible character, as ``public_tokenizers.PATTERN`` does.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in it:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                ids = enc.encode(part.column(1))
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; null ids decode to nothing."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in it:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                decoded = pa.array([enc.decode(x or b"") for x in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*part.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(batches, f"{kinds}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids, decoded)``: :func:`encode_documents`, then :func:`decode_documents`, in one pass.

    Both steps in a row would take two Python workers a task, each with tables of its own. The
    bytes are decoded from the packed ids alone. ``pattern`` as there.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in it:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                ids = enc.encode(part.column(1))
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                decoded = pa.array(list(map(enc.decode, ids)), pa.binary())
                cols = [part.column(0), sizes, pa.array(ids, pa.binary()), decoded]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
