"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialise


def _star(links: DataFrame, both: DataFrame, keep) -> DataFrame:
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(materialise(least, "component-least"), "u").where(keep & (F.col("v") != F.col("m"))).select(
        F.col("v").alias("u"), F.col("m").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``(a, b)`` links; the component is its smallest node.

    In a large star every neighbour above a node is linked to the node's smallest neighbour, in a small star all below it
    are. Links become shorter until each node points at its component. Every round is written to shared storage, and the number of
    links never grows. Rounds end when a checksum of the links repeats.
    """
    links = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                        "component-links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        if not seen[0]:
            break
        both = links.union(links.select("v", "u"))
        large = _star(both, both, F.col("v") > F.col("u"))
        links = materialise(large.distinct(), "component-large")
        down = links.where("v < u")
        small = _star(down, down, F.lit(True))
        own = down.groupBy("u").agg(F.min("v").alias("v"))
        links = materialise(small.union(own).where("u != v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "component-small")
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
