"""Connected components of links that stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.tables import stored


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none: the components are stars."""
    both = F.array(*(F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("u", 1), ("v", 0))))
    ends = edges.select(F.inline(both))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where(
        "up > 1 or (up > 0 and least = 0)"
    ).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the links ``a``, ``b``.

    Alternating large and small stars: every node hangs its larger neighbours below the smallest one,
    then its smaller ones, until all edges point at their component's smallest node. The number of
    rounds grows with the logarithm of the longest chain. Minima combine before the shuffle, and what
    is left for a node with very many neighbours is an ordinary join.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge now points from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = (
            down.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = stored(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
