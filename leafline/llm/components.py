"""Connected components of an edge table, by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges``; component is the smallest node reachable.

    Every round hooks each node's parent below the smallest parent among its neighbours and then
    halves the paths, so chains shrink geometrically. Rounds are written to the shared folder;
    parents only ever fall, so an unchanged sum (of their hashes, if nodes aren't whole numbers) means
    that it is done. Only sums reach the driver. Nodes may be of any type that has an order. Null
    ends are ignored; an empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = written(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    parent = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("p"))
    parent = written(parent, "parents")
    total = _sum(parent)
    for _ in range(max_rounds):
        near = (
            both.join(parent.select(F.col("node").alias("v"), F.col("p").alias("m")), "v")
            .groupBy("u").agg(F.min("m").alias("m"))
        )
        mine = parent.join(near.withColumnRenamed("u", "node"), "node")
        low = F.least("p", "m")
        moved = mine.select("node", low.alias("p")).union(mine.select(F.col("p").alias("node"), low.alias("p")))
        hooked = written(moved.groupBy("node").agg(F.min("p").alias("p")), "hooked")
        up = hooked.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = written(hooked.join(up, "p").select("node", F.least("p", "pp").alias("p")), "parents")
        last, total = total, _sum(parent)
        if total == last:
            return parent.select("node", F.col("p").alias("component"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _sum(parent: DataFrame):
    number = F.col("p") if isinstance(parent.schema["p"].dataType, IntegralType) else F.xxhash64("p")
    return parent.agg(F.sum(number.cast("decimal(38,0)"))).first()[0]
