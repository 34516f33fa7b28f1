"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, staged


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Alternate large-star and small-star steps until the links are stars.

    ``edges``: columns ``u`` and ``v`` (long), any direction, repeats allowed.
    Returns ``u``, ``root`` for every node that is not the smallest of its
    component; ``root`` is that smallest node.  Minima are aggregated before
    the shuffle and joined back, so a node with very many links never has to
    fit in one task.  Links to null or to the node itself are dropped; no
    links give an empty table.
    """
    edges = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    state = _digest(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.join(low, "u")
        small = hop.select("u", F.col("m").alias("v")).union(
            hop.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        following = staged(small, "links")
        reached = _digest(following)
        dropped(edges)
        edges = following
        if reached == state:
            break
        state = reached
    return edges.select("u", F.col("v").alias("root"))
