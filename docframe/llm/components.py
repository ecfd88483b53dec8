"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.common import discard, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v). Each node's chosen neighbours are tied to the least of them and itself."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = (side.where("v > u") if large else side).join(least, "u")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (u long, v long). Returns (node, component): each linked node but a component's least with that least node.
    Rounds grow with the square of the logarithm of the nodes at most; none gathers a node's neighbours in one row."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        nodes, pointed = now.select(F.countDistinct("u"), F.count(F.lit(1))).first()
        # done when every node has one link and no node that is pointed at points on
        if nodes == pointed and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, now = now, written(_stars(_stars(now, large=True), large=False))
        discard(before)
    raise RuntimeError("components did not settle")
