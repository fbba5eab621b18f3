"""Benchmark decontamination: size-partitioned bottom-k MinHash, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, written

#: A table of at most so many signatures or ids (about 100 MB) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 2_000_000
#: The size class of items that are shorter than a shingle.
SHORT = -1


def _key(id_col: str, text_col: str) -> Column:
    """What stands for a row: its id; rows with a null id are told apart by their texts."""
    return F.struct(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.sha2(F.coalesce(text_col, F.lit("")), 256)).alias("of"))


def _words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _shingled(df: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """One row for each shingle, repeats included; a text with fewer words is one shingle, none without a word."""
    words = df.select(id_col, _words(text).alias("w")).where(F.size("w") > 0)
    cols = [f"w{i}" for i in range(width)]
    last = F.greatest(F.size("w") - (width - 1), F.lit(1))
    zipped = F.arrays_zip(*(F.slice("w", i + 1, last).alias(c) for i, c in enumerate(cols)))
    return words.select(id_col, F.inline(zipped)).toDF(id_col, *cols)


def _hash(width: int) -> Column:
    """The MinHash order: one hash of the words."""
    return F.xxhash64(*(F.coalesce(F.col(f"w{i}"), F.lit("")) for i in range(width)))


def _string(width: int) -> Column:
    return F.concat_ws(" ", *(F.col(f"w{i}") for i in range(width)))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    containment: float = 0.8,
) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)``: items of which a document holds enough.

    ``n_shingles`` counts the item's distinct word shingles and ``n_shared`` those that the whole
    document holds; pairs with ``n_shared / n_shingles >= containment`` are returned, each once.

    Method. Items are partitioned by size (powers of two of their shingle count; those shorter than
    a shingle apart). An item of q shingles may miss at most m = floor((1 - containment) q) of them,
    so of its m + 1 smallest hashes (its bottom-k MinHash) any contaminated document holds one:
    nothing is missed, however long the document. Each size partition has its largest sketch value
    as a bound. Texts of fewer words than a shingle are probed for the partition of short items
    alone, all others for the rest; shingles above the largest bound of those are dropped before the
    join on hashes. Only the candidate documents are shingled again, to count shared shingles as strings.

    Null or wordless texts on either side match nothing. A text shorter than ``width`` words is
    one shingle, so a short item is found in documents that consist of it. Repeated items and
    documents with one id count as one set. Rows with a null id are told apart by their texts: each
    distinct text with a null id is a document (or an item) of its own, and is returned with a null id.
    """
    return _found(docs, items, doc_id, doc_text, item_id, item_text, width, containment).select(
        F.col("_doc.id").alias(doc_id),
        F.col("_item.id").alias(item_id),
        F.col("q").alias("n_shingles"),
        "n_shared",
        F.round(F.col("n_shared") / F.col("q"), 6).alias("containment"),
    )


def _found(
    docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str = "item_id", item_text: str = "text",
    width: int = 5, containment: float = 0.8, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    docs = docs.select(_key(doc_id, doc_text).alias("_doc"), F.col(doc_text).alias("_text"))
    items = items.select(_key(item_id, item_text).alias("_item"), F.col(item_text).alias("_text"))

    full = F.col(f"w{width - 1}").isNotNull()
    grams = _shingled(items, "_item", "_text", width).select("_item", _string(width).alias("s"), _hash(width).alias("h"), full.alias("full"))
    grams = grams.distinct()
    sizes = grams.groupBy("_item").agg(F.count("*").alias("q"), F.max("full").alias("long"))
    size_class = F.when(F.col("long"), F.floor(F.log2("q")).cast("int")).otherwise(SHORT)
    grams = written(grams.join(sizes, "_item").select("_item", "s", "h", "q", size_class.alias("size_class")), "items")
    # at most so many may be missing; the small constant keeps 0.8 * 5 from counting as more than 4
    k = F.floor((1 - containment) * F.col("q") + 1e-9) + 1
    by_hash = Window.partitionBy("_item").orderBy("h")  # one item's shingles
    ranked = grams.withColumn("rank", F.dense_rank().over(by_hash))
    sketch = written(ranked.where(F.col("rank") <= k).select("h", "_item", "size_class"), "sketch")
    # a row for each power of two
    bounds = {r["size_class"]: r["top"] for r in sketch.groupBy("size_class").agg(F.max("h").alias("top")).collect()}
    rows = sketch.count()
    probes = sketch.select("h", "_item")
    if rows <= broadcast_rows:
        probes = F.broadcast(probes)

    whole = max((bound for c, bound in bounds.items() if c != SHORT), default=None)
    top = F.when(full, F.lit(whole).cast("long")).otherwise(F.lit(bounds.get(SHORT)).cast("long"))
    hits = _shingled(docs, "_doc", "_text", width).select("_doc", _hash(width).alias("h"), top.alias("top")).where("h <= top")
    candidates = written(hits.join(probes, "h").select("_doc", "_item").distinct(), "candidates")

    ids = candidates.select("_doc").distinct()
    if ids.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    again = _shingled(docs.join(ids, "_doc", "left_semi"), "_doc", "_text", width).select("_doc", _string(width).alias("s")).distinct()
    wanted = candidates.join(grams.select("_item", "q", "s"), "_item")
    shared = again.join(wanted, ["_doc", "s"]).groupBy("_doc", "_item", "q").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.lit(containment) * F.col("q") - 1e-9)


def without_benchmark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", **how) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns.

    Rows of one id go together; rows with a null id go or stay by their own text. With no
    documents or no items the documents come back as they are.
    """
    own = free_name(docs, "_doc")
    leaks = written(_found(docs, items, doc_id, doc_text, **how).select(F.col("_doc").alias(own)).distinct(), "leaks")
    if leaks.count() <= BROADCAST_ROWS:
        leaks = F.broadcast(leaks)
    return docs.withColumn(own, _key(doc_id, doc_text)).join(leaks, own, "left_anti").select(*docs.columns)
