"""URL filters: dated list entries become validity intervals, joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: A key with more captures than a thousandth of all (and than this) is dealt to several tasks.
HOT_ROWS = 20_000


def host_of(url: str | Column) -> Column:
    """The lower-case host of a URL, without user, port or a trailing dot; null if there is none.

    An address in brackets keeps them.
    """
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def host_suffixes(host: str | Column) -> Column:
    """The host and its parent domains of two labels at least; an address has no parents."""
    host = F.col(host) if isinstance(host, str) else host
    labels = F.when(host.rlike(r"^\[|^[0-9.]+$"), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), "."))


def validity(changes: DataFrame, key: str = "domain", at: str = "listed_on", listed: str = "listed") -> DataFrame:
    """``(key, valid_from, valid_to)``: when each key is listed; ``valid_to`` is exclusive, null if still so.

    The last change at or before a moment decides; of several on one date, a removal counts.
    Changes with a null key or date are ignored, a null state is a removal.
    """
    known = changes.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    daily = known.groupBy(key, at).agg(F.min(F.coalesce(F.col(listed), F.lit(False))).alias("on"))
    nxt = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    return daily.select(key, F.col(at).alias("valid_from"), nxt.alias("valid_to"), "on").where("on").drop("on")


def judge(
    captures: DataFrame, changes: DataFrame, id_col: str = "page_id", url: str = "url", fetched: str = "fetched_on",
    key: str = "domain", at: str = "listed_on", listed: str = "listed",
) -> DataFrame:
    """``captures`` ids with ``blocked``, ``n_entries`` and ``matched``: the active entries at fetch time.

    A capture meets the entries of its host and of the host's parent domains; ``matched`` is the
    longest such domain, null if none. Captures without a host or a fetch time meet none and are
    not blocked. Rows with one id count as one capture.

    Keys that hold many captures are salted: they number at most a thousand, so their list is
    broadcast, and their few intervals are repeated once for each salt.
    """
    each = captures.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), F.col(fetched).alias("_at"))
    meets = each.where(F.col("_host").isNotNull() & F.col("_at").isNotNull())
    meets = meets.select("_id", "_at", F.explode(host_suffixes("_host")).alias("_key"))
    sizes = written(meets.groupBy("_key").agg(F.count("*").alias("n")), "url-keys")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // 1000)
    hot = sizes.where(F.col("n") > limit).select("_key", F.ceil(F.col("n") / limit).cast("int").alias("salts"))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    dealt = meets.join(F.broadcast(hot), "_key", "left").select("_id", "_at", "_key", F.pmod(F.xxhash64("_id", "_at"), salts).alias("salt"))
    spans = validity(changes, key, at, listed).withColumnRenamed(key, "_key")
    spans = spans.join(F.broadcast(hot), "_key", "left").select(
        "_key", "valid_from", "valid_to", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)).alias("salt")
    )
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    found = dealt.join(spans, ["_key", "salt"]).where(active).select("_id", "_key")
    every = each.select("_id", F.lit(None).cast("string").alias("_key")).union(found)
    longest = F.max(F.when(F.col("_key").isNotNull(), F.struct(F.length("_key").alias("n"), F.col("_key").alias("k"))))
    out = every.groupBy("_id").agg(F.count_distinct("_key").alias("n_entries"), longest.alias("m"))
    return out.select(F.col("_id").alias(id_col), (F.col("n_entries") > 0).alias("blocked"), "n_entries", F.col("m.k").alias("matched"))
