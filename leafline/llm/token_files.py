"""Token-id files: canonical length-limited Huffman codes in independent blocks.

The format is a Parquet table whose rows are blocks, in ascending order of document id, and a
second one with the code: for each token id its code length. A block holds the bits of its
documents, each starting at a byte, the documents' ids and token counts, and the bit offset of
every ``EVERY``-th token as a checkpoint, so that any block, and any stretch between two
checkpoints, is decoded without what stands before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import held_by_worker, shared_folder, written
from .words import WordTable

LONGEST = 18  # bits of a code at most; the decoding table has 2 ** LONGEST rows
EVERY = 256  # tokens between two checkpoints
BLOCK_TOKENS = 1 << 20  # a block ends with the document that reaches so many
#: Rows that a task tokenizes at once, and codes that it packs at once.
STEP, PACKED = 1000, 1 << 18
#: Words that one Python worker keeps the ids of; beyond it starts anew.
CACHE_ENTRIES = 900_000


class Tokens:
    """The tokenizers library behind a table of words; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()} - {""})
        self.line_end = self._ids("\n")
        self.words = WordTable(self._words, lambda t: self._ids(t).tobytes(), CACHE_ENTRIES)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _words(self, words: list[str], together: int = 5000) -> list[bytes]:
        """Words are encoded as lines of one text, whose ids are cut again at the line ends."""
        if len(self.line_end) != 1:
            return [self._ids(w).tobytes() for w in words]
        out = []
        for at in range(0, len(words), together):
            part = words[at : at + together]
            ids = self._ids("\n".join(part))
            ends = np.flatnonzero(ids == self.line_end[0])
            starts, stops = np.concatenate([[0], ends + 1]), np.append(ends, len(ids))
            if len(starts) != len(part):
                raise ValueError("a line end didn't come back as a token of its own")
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist())]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Texts that hold the string of an added token are encoded whole, as it is cut out before all words."""
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.words.encode(texts)
        out = self.words.encode(pc.if_else(pa.array(odd), pa.scalar(None, texts.type), texts))
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._ids(texts[i].as_py()).tobytes()
        return out


def _tokens(path: str) -> Tokens:
    return held_by_worker(("token_files", path), lambda: Tokens(path))


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, lo, hi, counts)``: ids of whole texts, the low and the high 16 bits apart (``hi`` null if all zero).

    Each task adds a last row that has nothing but ``counts``: how often it has seen each id. Words
    are looked up in a table of those seen before, which is right only for tokenizers that cut a text
    at a blank after a visible character, as byte-level ones with the usual patterns do.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        total, schema = np.zeros(0, np.int64), None
        for batch in it:
            for i in range(0, batch.num_rows, STEP):
                part = batch.slice(i, STEP)
                packed = [p + end for p in _tokens(tokenizer_path).encode(part.column(1))]
                ids = np.frombuffer(b"".join(packed), "<u4")
                total = _added(total, np.bincount(ids))
                low, tops = ids.astype("<u2").tobytes(), np.cumsum([0] + [len(p) // 2 for p in packed]).tolist()
                lo = [low[a:b] for a, b in zip(tops, tops[1:])]
                hi = [None] * len(lo)
                if len(total) > 1 << 16:
                    high = (ids >> 16).astype("<u2").tobytes()
                    hi = [high[a:b] for a, b in zip(tops, tops[1:])]
                sizes = pa.array([len(p) // 4 for p in packed], pa.int64())
                cols = [part.column(0), sizes, pa.array(lo, pa.binary()), pa.array(hi, pa.binary()), pa.nulls(len(lo), pa.binary())]
                got = pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "lo", "hi", "counts"])
                schema = got.schema
                yield got
        if schema is not None:
            yield pa.RecordBatch.from_pylist([{"counts": total.astype("<i8").tobytes()}], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"`{id_col}` {kind}, n_tokens long, lo binary, hi binary, counts binary")


def _added(total: np.ndarray, seen: np.ndarray) -> np.ndarray:
    if len(seen) > len(total):
        seen, total = total, seen.astype(np.int64)
    total[: len(seen)] += seen
    return total


def _joined(lo: list[bytes], hi: list[bytes | None]) -> np.ndarray:
    ids = np.frombuffer(b"".join(lo), "<u2").astype(np.uint32)
    if any(h is not None for h in hi):
        high = np.frombuffer(b"".join(h if h is not None else bytes(len(x)) for x, h in zip(lo, hi)), "<u2")
        ids |= high.astype(np.uint32) << 16
    return ids


def token_counts(ids: DataFrame) -> DataFrame:
    """``(token, n)`` over all documents, from what each task has counted."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in it:
            for counts in batch.column(0).to_pylist():
                total = _added(total, np.frombuffer(counts, "<i8"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["token", "n"])

    rows = ids.where("counts is not null").select("counts")
    return rows.mapInArrow(batches, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits, by package-merge. One symbol gets one bit."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols don't fit codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(longest - 1):
        levels.append(is_leaf)
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        row, is_leaf = both[rank], rank < n
    levels.append(is_leaf)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code: shorter codes first, equal lengths by token id."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((tokens, lengths))
        self.tokens, self.lengths = tokens[order].astype(np.int64), lengths[order].astype(np.int64)
        self.longest = int(self.lengths.max(initial=1))
        steps = np.left_shift(1, self.longest - self.lengths)
        self.codes = np.concatenate([[0], np.cumsum(steps)[:-1]]) >> (self.longest - self.lengths) if len(tokens) else np.empty(0, np.int64)

    def of_token(self) -> tuple[np.ndarray, np.ndarray]:
        top = int(self.tokens.max(initial=-1)) + 1
        code, length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.tokens], length[self.tokens] = self.codes.astype(np.uint64), self.lengths
        return code, length

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each bit pattern of the longest length: the token that it starts with, and that code's length."""
        token, length = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.uint8)
        spread = np.left_shift(1, self.longest - self.lengths)
        used = int(spread.sum())
        token[:used], length[:used] = np.repeat(self.tokens, spread), np.repeat(self.lengths, spread)
        return token, length


def pack_bits(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of documents of ``sizes`` tokens, each from a byte on: bytes, first byte of each, bit offset of each token."""
    size = lengths[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    bits = total[firsts[1:]] - total[firsts[:-1]]
    starts = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    at = total[:-1] + np.repeat(8 * starts[:-1] - total[firsts[:-1]], sizes)
    # each code within two 32-bit words; the bits of different codes don't meet, so sums are unions
    packed = np.zeros(int(starts[-1] // 4 + 2), np.uint32)
    for i in range(0, len(ids), PACKED):
        own = at[i : i + PACKED]
        wide = codes[ids[i : i + PACKED]] << (64 - (own & 31) - size[i : i + PACKED]).astype(np.uint64)
        first = int(own[0] >> 5)
        word, n = (own >> 5) - first, int((own[-1] >> 5) - first + 2)
        part = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n)
        part[1:] += np.bincount(word, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[: n - 1]
        packed[first : first + n] += part.astype(np.uint32)
    return packed.astype(">u4").view(np.uint8)[: starts[-1]], starts, at


def unpack_bits(data: bytes, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """Tokens of stretches that start at bit ``starts`` and hold ``counts`` tokens; all stretches advance together."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    word = np.zeros(len(raw) - 4, np.uint64)  # 40 bits from each byte on
    for i in range(5):
        word = word << np.uint64(8) | raw[i : len(raw) - 4 + i]
    token, length = table
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].astype(np.int64), counts[order]
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1][order]
    out = np.empty(int(counts.sum()), np.uint32)
    mask = np.int64((1 << longest) - 1)
    for t in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -t, side="left"))  # stretches with more than t tokens
        pos = at[:n]
        window = (word[pos >> 3] >> (40 - longest - (pos & 7)).astype(np.uint64)).astype(np.int64) & mask
        out[firsts[:n] + t] = token[window]
        pos += length[window]
    return out


def _stretches(sizes: np.ndarray) -> np.ndarray:
    """The tokens of each stretch between checkpoints."""
    per = (sizes + EVERY - 1) // EVERY
    counts = np.full(int(per.sum()), EVERY, np.int64)
    last = np.cumsum(per)[per > 0] - 1
    counts[last] = sizes[per > 0] - (per[per > 0] - 1) * EVERY
    return counts


BLOCK = "part int, before long, n_tokens long, doc_ids array<{id}>, sizes array<long>, starts array<int>, checks array<long>, bits binary"


def write_files(ids: DataFrame, path: str, id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the table of :func:`token_ids` as token files at ``path``, in ascending order of id.

    Counts are over all documents; only they (a row for each token id) and the code pass through
    the driver. Ids are dealt out by ranges of document ids and encoded there, a block at a time;
    ``ids`` should be a written table, as the ranges are found by a scan of its own. Rows with one
    id stay together, ordered by their tokens; null ids come first; a document without a token is
    an empty stretch of its block. No row gives no block. Codes have 18 bits at most, so more than
    2^18 distinct ids raise a ``ValueError``.
    """
    spark = ids.sparkSession
    rows = token_counts(ids).orderBy("token").collect()
    tokens = np.array([r["token"] for r in rows], np.int64)
    lengths = code_lengths(np.array([r["n"] for r in rows], np.int64))
    spark.createDataFrame(pd.DataFrame({"token": tokens, "bits": lengths}), "token long, bits long").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(Code(tokens, lengths).of_token())
    kind = ids.schema[id_col].dataType.simpleString()
    each = ids.where("counts is null").select(id_col, "n_tokens", "lo", "hi")
    dealt = each.repartitionByRange(_parts(spark), id_col).sortWithinPartitions(id_col, "n_tokens", "lo", "hi")
    blocks = dealt.mapInArrow(_blocks(shared, block_tokens), BLOCK.format(id=kind))
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _blocks(shared: Broadcast, block_tokens: int) -> Callable:
    """Encodes rows in their order; only the documents of one block are held."""

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        codes, lengths = shared.value
        held: list[tuple] = []
        before, tokens = 0, 0

        def block(key: pa.DataType) -> pa.RecordBatch:
            doc_ids, sizes, lo, hi = zip(*held)
            bits, starts, at = pack_bits(_joined(lo, hi), np.array(sizes, np.int64), codes, lengths)
            tops = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            checks = np.concatenate([at[a:b:EVERY] for a, b in zip(tops, tops[1:])])
            cols = [
                pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([tokens], pa.int64()), pa.array([doc_ids], pa.list_(key)),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([starts[:-1]], pa.list_(pa.int32())), pa.array([checks], pa.list_(pa.int64())),
                pa.array([bits.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["part", "before", "n_tokens", "doc_ids", "sizes", "starts", "checks", "bits"])

        for batch in it:
            key = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                tokens += row[1]
                if tokens >= block_tokens:
                    yield block(key)
                    before += tokens
                    held, tokens = [], 0
        if held:
            yield block(key)

    return blocks


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids)`` for each document: its ids, and how many stand before them in the files.

    Blocks are decoded apart from one another. A block knows how many ids its part holds before
    it; the parts' own starts (a row for each part, as many as the writer's range partitions) are
    a running sum and are broadcast.
    """
    rows = spark.read.parquet(f"{path}/code").collect()
    code = Code(np.array([r["token"] for r in rows], np.int64), np.array([r["bits"] for r in rows], np.int64))
    shared = spark.sparkContext.broadcast((code.longest, code.table()))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("before")).alias("start"), "doc_ids", "sizes", "checks", "bits"
    )

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest, table = shared.value
        for batch in it:
            key = batch.schema.field("doc_ids").type.value_type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sizes = np.array(row["sizes"], np.int64)
                raw = unpack_bits(row["bits"], np.array(row["checks"], np.int64), _stretches(sizes), table, longest).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                ids = [raw[4 * a : 4 * b] for a, b in zip(ends - sizes, ends)]
                cols = [pa.array(row["doc_ids"], key), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids"])

    return placed.mapInArrow(decode, f"`{id_col}` {kind}, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, n_tokens, ids)``: ``docs`` tokenized, written as token files in the shared folder and read back.

    Null counts as empty; without ``end_id`` such a text has no token, and keeps its row. Rows with
    null or repeated ids stay, as :func:`write_files` orders them. The strings of added tokens
    become their ids, as by the library's default.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_files(written(token_ids(docs, tokenizer_path, end_id, id_col, text_col), "token-ids"), path, id_col)
    return read_files(spark, path, id_col)
