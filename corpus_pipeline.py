"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import decontaminate, langid, minhash, prefix_bpe, simhash
from leafline.llm.shared import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language; those without a letter, or of no clear language, go."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: Jaccard 0.8 of five-word shingles.

    SimHash links documents, and whole sets of shingles confirm its links, each of them: no band or
    signature rules one out. MinHash then looks for those between its groups, as copies of that
    likeness mostly differ in more bits than blocks can cover.
    """
    groups = simhash.near_duplicates(docs, width=5).select("doc_id", F.col("component_id").alias("group"))
    return minhash.keep_one_of_each(docs, width=5, least=0.8, groups=groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text."""
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = prefix_bpe.round_trip(docs, path, pattern)
    return back.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: A trained classifier and a tokenizer can't be said in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
