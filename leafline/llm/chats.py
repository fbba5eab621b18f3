"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are then rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name


def prefix_hashes(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, n, h1, h2)``: for each turn, the hashes of the conversation up to it.

    A rolling hash: each turn's hash is salted with its position, and two running XORs of 64 bits
    each tell prefixes apart. Turns are ordered by turn number, then role and text, nulls first.
    """
    within = Window.partitionBy(conv_id).orderBy(turn, role, text)
    rows = turns.select(
        F.col(conv_id).alias("conv"), F.row_number().over(within).alias("pos"), F.count("*").over(Window.partitionBy(conv_id)).alias("n"),
        F.col(role).alias("role"), F.col(text).alias("text"),
    )
    so_far = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    said = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return rows.select(
        "conv", "pos", "n",
        F.bit_xor(F.xxhash64(F.lit(1), *said)).over(so_far).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *said)).over(so_far).alias("h2"),
    )


def maximal(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The ids of conversations that are no prefix of a longer one; of equal ones the smallest id.

    Whole conversations are first grouped by hash, and the prefixes of longer ones made distinct,
    so both sides of the anti-join hold each hash once however often a conversation was logged.
    A null id is a conversation like any other.
    """
    hashes = prefix_hashes(turns, conv_id, turn, role, text)
    whole = hashes.where("pos = n").groupBy("pos", "h1", "h2").agg(F.min(F.struct(F.col("conv").isNull().alias("last"), "conv")).alias("c"))
    prefixes = hashes.where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(prefixes, ["pos", "h1", "h2"], "left_anti").select(F.col("c.conv").alias(conv_id))


def rendered_turn(role: str | Column = "role", text: str | Column = "text") -> Column:
    role, text = (F.col(c) if isinstance(c, str) else c for c in (role, text))
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def render(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, n_turns, chat)`` for each maximal conversation, its turns in order.

    Null roles and texts render as empty. Turns with a null id make one conversation; repeated rows
    are turns like any other. Texts are rendered as they are, end marks within them too. A row
    holds one conversation, as the result must.
    """
    keep, kept = maximal(turns, conv_id, turn, role, text), free_name(turns, "_conv")
    mine = turns.join(keep.withColumnRenamed(conv_id, kept), F.col(conv_id).eqNullSafe(F.col(kept)), "left_semi")
    one = F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    in_order = F.sort_array(F.collect_list(one))
    chats = mine.groupBy(conv_id).agg(F.count("*").alias("n_turns"), in_order.alias("turns"))
    return chats.select(conv_id, "n_turns", F.array_join(F.transform("turns", lambda t: rendered_turn(t["r"], t["x"])), "").alias("chat"))
