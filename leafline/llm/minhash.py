"""MinHash near-duplicates: banded candidates, sequential Bayesian verification of signature batches, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import BROADCAST_IDS, held_by_worker, small_batches, table_or_shuffle, without_ids, written

HASHES = 256  # minhashes of a signature
BANDS, ROWS = 32, 5  # at similarity 0.8 all bands miss with probability 3e-6, at 0.85 with 2e-8
BATCH = 64  # bits of the signature that are compared at a time: a long
MISS = 1e-6
WORDS_KEPT = 200_000  # word hashes that a Python worker keeps
STAR_ROUNDS = 1
BLOCK_BYTES, BLOCK_SETS = 1 << 21, 512  # of the sets of a key that are compared with another such block at once
SEED = 42

_rng = np.random.default_rng(12)
_ODD32 = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD64 = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits (two multiply-and-shift steps)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int, known: _WordHashes | None = None) -> np.ndarray:
    """The distinct word shingles as ascending 64-bit hashes; fewer words are one shingle, no word is none.

    Words stand apart by blanks and the control characters from tab to carriage return; A-Z count as a-z.
    """
    known = _WordHashes() if known is None else known
    words = (text or "").encode().lower().split()  # of bytes, both touch ASCII alone
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(width, len(h))
    if not wide:
        return h
    own = np.zeros(len(h) - wide + 1, np.uint64)
    for i in range(wide):
        own = _mixed(own * _ODD64[i % 64] + h[i : len(h) - wide + 1 + i])
    return np.unique(own)


def minhashes(shingles: np.ndarray, step: int = 2048) -> np.ndarray:
    """The smallest of each hash over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    return reduce(np.minimum, ((_ODD32[:, None] * x[None, i : i + step]).min(axis=1) for i in range(0, len(x), step)))


def signature(mins: np.ndarray) -> np.ndarray:
    """One bit of each minhash, 64 to a long: equal minhashes agree, others with one half."""
    bits = ((mins ^ (mins >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=-1).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of minhashes."""
    rows = mins[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _ODD64[:ROWS]).sum(axis=2, dtype=np.uint64) + _ODD64[8 : 8 + BANDS]).view(np.int64)


def fewest_matches(least: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """For each prefix of whole batches, how many bits must agree for a pair to stay.

    With similarity s, bits agree with probability (1 + s) / 2. Beforehand every s from 0 to 1 is
    as likely as any other; a pair is pruned when, given what agrees so far, s reaches ``least``
    with probability below ``miss``. At s = ``least`` itself a batch then prunes about a share of
    ``miss`` of the pairs (2.5e-6 at most for 0.8 and 1e-6), at any larger s fewer.
    """
    agree = np.linspace(0.5, 1, 20_001)[:-1]
    near = agree >= (1 + least) / 2 - 1e-9
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            weight = m * np.log(agree) + (n - m) * np.log1p(-agree)
            top = weight.max()
            if log(max(np.exp(weight[near] - top).sum(), 1e-300)) - log(np.exp(weight - top).sum()) >= log(miss):
                out.append(m)
                break
    return out


def may_link(least: float, miss: float = MISS) -> Column:
    """Whether two sets of sizes ``na`` and ``nb`` and signatures ``a0``.. and ``b0``.. may be as similar as ``least``: sizes, then batch after batch."""
    ok = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    apart = F.lit(0)
    for i, m in enumerate(fewest_matches(least, miss)):
        apart = apart + F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
        ok = ok & (apart <= BATCH * (i + 1) - m)
    return ok


def _word_hashes() -> _WordHashes:
    known = held_by_worker("word-hashes", _WordHashes)
    if len(known) > WORDS_KEPT:
        known.clear()
    return known


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, n, set_key, sig, bands)``: no key, signature or bands for an empty set."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it):
            known = _word_hashes()
            sets = [shingle_set(t, width, known) for t in batch.column(1).to_pylist()]
            mins = np.array([minhashes(s) for s in sets if len(s)], np.uint32).reshape(-1, HASHES)
            sigs, bands = iter(signature(mins)), iter(band_keys(mins))
            cols = [
                batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(sigs) if len(s) else None for s in sets], pa.list_(pa.int64())), pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "set_key", "sig", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"id {kind}, n long, set_key binary, sig array<long>, bands array<long>")


def _sets_of(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(node, raw)`` for a written table of ``(node, set_key, rep)``; only texts that stand for one of its sets are cut again."""

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small_batches(it):
            known = _word_hashes()
            raw = [shingle_set(t, width, known).tobytes() for t in batch.column(0).to_pylist()]
            out = {k: r for r in raw if (k := xxhash.xxh3_128_digest(r)) not in seen}
            seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], names=["set_key", "raw"])

    hint = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda df: df
    texts = docs.join(hint(wanted.select(F.col("rep").alias("_rep")).distinct()), F.col(id_col).eqNullSafe(F.col("_rep")), "left_semi").select(text_col)
    cut = texts.mapInArrow(sets, "set_key binary, raw binary").join(hint(wanted.select("set_key", "node")), "set_key")
    return written(cut.groupBy("node").agg(F.first("raw").alias("raw")), "shingle-sets")


def _close(x: bytes, y: bytes, percent: int) -> bool:
    both = np.frombuffer(x + y, np.uint64).copy()
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _confirmed(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole sets reach ``least``, tested in whole numbers of hundredths."""
    percent = round(least * 100)

    def close(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(it):
            kept = [_close(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(known.select(F.col("node").alias("a"), F.col("raw").alias("ra")), "a")
    both = both.join(known.select(F.col("node").alias("b"), F.col("raw").alias("rb")), "b").select("a", "b", "ra", "rb")
    return written(both.mapInArrow(close, "a long, b long"), "near-links")


def links_of_blocks(rows: pa.Table, least: float, need: list[int]) -> list[tuple[int, int]]:
    """Links between sets of two blocks of a key (or within one) that join components which nothing joins yet.

    Sizes and signature batches prune all pairs at once, in arrays; each pair counts under its first
    common band only, and two components are compared until one link between them is found.
    """
    column = lambda c: rows.column(c).to_numpy()
    node, n, block, key = column("node"), column("n"), column("block"), rows.column("key")[0].as_py()
    _, comp = np.unique(column("comp"), return_inverse=True)
    sig = np.stack([column(f"s{i}") for i in range(len(need))], axis=1).view(np.uint64)  # else of negative ones the bits of the absolute value count
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    a, b = np.flatnonzero(block == column("lo")), np.flatnonzero(block == column("hi"))
    ok = (comp[a][:, None] != comp[b][None]) & (n[a][:, None] >= least * n[b][None] - 1e-9) & (n[b][None] >= least * n[a][:, None] - 1e-9)
    if column("lo")[0] == column("hi")[0]:
        ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None]
    i, j = np.nonzero(ok)
    i, j, apart = a[i], b[j], np.zeros(len(i), np.int64)
    for k, m in enumerate(need):
        apart = apart + np.bitwise_count(sig[i, k] ^ sig[j, k])
        stay = apart <= BATCH * (k + 1) - m
        i, j, apart = i[stay], j[stay], apart[stay]
    for at in range(0, len(i), 1 << 16):  # of a band in common, the first
        part = slice(at, at + (1 << 16))
        first = (bands[i[part]] == bands[j[part]]).argmax(axis=1)
        i[part] = np.where(bands[i[part], first] == key, i[part], -1)
    i, j = i[i >= 0], j[i >= 0]
    raw, root, percent, out = rows.column("raw"), list(range(comp.max(initial=0) + 1)), round(least * 100), []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    raw = raw.to_pylist()
    for x, y in zip(i.tolist(), j.tolist()):
        cx, cy = find(comp[x]), find(comp[y])
        if cx != cy and _close(raw[x], raw[y], percent):
            root[cx] = cy
            out.append((int(node[x]), int(node[y])))
    return out


def _links_between(held: DataFrame, bands: DataFrame | None, known: DataFrame, least: float, need: list[int]) -> DataFrame:
    """Links between components that share a key: its sets are dealt to blocks of bounded size, and any two blocks meet in one group.

    Without ``bands`` a pair counts under each key that it shares.
    """
    share = lambda c, of: F.ceil(F.sum(c) / F.lit(of))
    sizes = held.groupBy("key").agg(F.greatest(share(F.col("n") * 8, BLOCK_BYTES), share(F.lit(1), BLOCK_SETS)).alias("blocks"))
    placed = held.join(table_or_shuffle(written(sizes, "key-blocks")), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = placed.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")

    def linked(rows: pa.Table) -> pa.Table:
        found = links_of_blocks(rows, least, need)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    full = met.join(known, "node").withColumn("bands", F.array("key")) if bands is None else met.join(known.join(bands, "node"), "node")
    return written(full.groupBy("key", "lo", "hi").applyInArrow(linked, "a long, b long"), "block-links")


def _side(held: DataFrame, side: str) -> DataFrame:
    sig = [F.col(f"s{i}").alias(f"{side}{i}") for i in range(HASHES // BATCH)]
    return held.select("key", F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("comp").alias(f"c{side}"), *sig)


def _links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, least: float, miss: float, groups: DataFrame | None = None) -> DataFrame | None:
    """``(node, component)`` of sets that are linked with another, or None.

    Sets of a group, ``(node, group)`` in the written table ``groups``, are compared before any others: with the
    first of their group, then with all of it that aren't in one component yet, on whole sets only.
    """
    sig = [F.col("sig")[i].alias(f"s{i}") for i in range(HASHES // BATCH)]
    tokens = nodes.select("node", "n", *sig, F.explode("bands").alias("key"))
    often = written(tokens.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    held = written(tokens.join(table_or_shuffle(often), "key", "left_semi").withColumn("comp", F.col("node")), "shared-bands")
    close = may_link(least, miss) & (F.col("ca") != F.col("cb"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = table_or_shuffle(written(wanted.distinct(), "wanted"))
        own = written(nodes.select("node", "set_key", "rep").join(wanted, "node", "left_semi"), "wanted-sets")
        return _sets_of(own, docs, id_col, text_col, width)

    links = comps = None
    for turn in range(0 if groups is None else -2, STAR_ROUNDS + 1):
        if turn == -2:
            firsts = written(groups.groupBy("group").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("group", "a"), "group-firsts")
            pairs = groups.join(table_or_shuffle(firsts), "group").where("a < node").select("a", F.col("node").alias("b"))
            pairs = written(pairs.distinct(), "group-pairs")
            more = _confirmed(pairs, sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), least)
        elif turn < 0:
            own = groups if comps is None else groups.join(comps, "node", "left")
            own = own.withColumn("comp", F.col("node") if comps is None else F.coalesce("component", "node"))
            mixed = own.groupBy("group").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("group")
            mixed = own.join(table_or_shuffle(written(mixed, "mixed-groups")), "group", "left_semi")
            mixed = written(mixed.join(nodes, "node").select(F.xxhash64("group").alias("key"), "node", "n", *sig, "comp").distinct(), "grouped-bands")
            more = mixed if mixed.isEmpty() else _links_between(mixed, None, sets_of(mixed.select("node")), least, [0] * len(sig))
        elif turn < STAR_ROUNDS:  # each set is compared with one of its group, in each turn with another
            order = F.xxhash64("node", F.lit(turn))
            stars = held.groupBy("key").agg(F.min(order).alias("first"))
            stars = _side(held.join(stars, (held["key"] == stars["key"]) & (order == F.col("first"))).select(held["*"]), "a")
            pairs = stars.join(_side(held, "b"), "key").where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = written(pairs.distinct(), "star-pairs")
            more = _confirmed(pairs, sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), least)
        else:  # then all that are not in one component yet
            more = _links_between(held, nodes.select("node", "bands"), sets_of(held.select("node")), least, fewest_matches(least, miss))
        grown = not more.isEmpty()
        if grown:
            links = more if links is None else links.union(more)
            comps = written(connected_components(links), "minhash-comps")
        if grown and turn >= 0 or comps is not None and turn == -1:
            held = held.drop("comp").join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if 0 <= turn < STAR_ROUNDS:
            mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
            held = written(held.join(table_or_shuffle(written(mixed, "mixed-keys")), "key", "left_semi"), "mixed-bands")
            if held.isEmpty():
                break
    return comps


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, miss: float = MISS, link_empty: bool = False,
    groups: DataFrame | None = None,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row: the smallest id that links of Jaccard ``least`` between shingle sets reach.

    Equal sets meet before any join. Sets that share a band's key are candidates; a pair is dropped
    when its sizes rule it out or, after a batch of 64 signature bits, its posterior chance of
    reaching ``least`` is under ``miss``; all that remain are confirmed on their whole sets. A large
    group of near copies isn't expanded into pairs: its members are compared with one of them, then
    those of keys with several components with another. What such keys still hold is dealt to blocks
    of bounded size, and each two blocks of a key are compared in arrays, until a link between two
    components is found; so only links become rows, and no key is one task.

    A text of fewer words than ``width`` is one shingle; a null, empty or blank one has no shingle
    and links with nothing, or with all others of its kind if ``link_empty``. Rows come back as often as they are there. Rows that share an id are
    linked by their texts alone. A row with a null id keeps it, links like any other and never names
    a component: where no id is reachable, its component is null. ``groups`` has ids and a ``group``
    that another method gave them: rows of a group are compared on whole sets before bands are, with
    its first and then with all that aren't linked yet, whatever their bands or signatures; so no
    link within a group is missed, and those linked aren't compared again. It adds no link that isn't one.
    """
    prints = written(_prints(docs, id_col, text_col, width), "minhash-prints")
    first = {c: F.first(c).alias(c) for c in ("n", "sig", "bands")}
    nodes = prints.where("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), *first.values()).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "minhash-sets")
    if groups is not None:
        groups = prints.where("n > 0").select("id", "set_key").join(groups.select(F.col(id_col).alias("id"), "group"), "id")
        groups = written(groups.select("set_key", "group").distinct().join(nodes.select("set_key", "node"), "set_key").select("node", "group").distinct(), "grouped-sets")
    comps = _links(nodes, docs, id_col, text_col, width, least, miss, groups)
    found = nodes.select("set_key", "rep", "node")
    if comps is not None:
        linked = comps.join(found, "node")
        smallest = written(linked.groupBy("component").agg(F.min("rep").alias("low")), "smallest-ids")
        of = written(comps.join(table_or_shuffle(smallest), "component").select("node", "low"), "node-ids")
        found = found.join(table_or_shuffle(of), "node", "left").withColumn("rep", F.coalesce("low", "rep"))
    named = written(found.select("set_key", F.col("rep").alias("of_set")), "set-ids")
    alone = F.col("id")
    if link_empty:
        alone = F.lit(prints.where("n = 0").agg(F.min("id")).first()[0])
    out = prints.select("id", "n", "set_key").join(table_or_shuffle(named), "set_key", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("of_set")).otherwise(alone).alias("component_id")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``components`` with ``kept``: whether the row has its component's smallest id (or no id is reachable)."""
    return components(docs, id_col, **how).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those whose id isn't the smallest of its component; texts without a word are copies of one another.

    Rows that share an id are one document and stay or go together; rows with a null id stay.
    """
    later = components(docs, id_col, text_col, link_empty=True, **how).where(F.col(id_col) != F.col("component_id"))
    return without_ids(docs, written(later.select(id_col), "copies"), id_col)
