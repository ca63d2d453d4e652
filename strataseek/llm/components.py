"""Connected components of a link table, all on the executors.

Alternating large-star and small-star rounds: each hangs a node's neighbours on the
smallest of them, until every node hangs on its component's smallest node. A round is
an aggregation (combined before the shuffle) and a join on the node, which adaptive
execution splits where one node has very many links. Rounds end in written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataseek.llm.common import written_clean


def _hung(pairs: DataFrame) -> DataFrame:
    """Neighbours of each node with the smallest of node and neighbours: (u, v, low)."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"))
    # the shift by 0 hides that the aggregation has dealt out its rows by u already: with a shuffle
    # on either side of the join, adaptive execution can split the partition of a node with very many links
    low = low.select(F.shiftright("u", 0).alias("u"), F.least("u", "low").alias("low"))
    return pairs.join(low, "u")


def _settled(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one only, on which nothing above it hangs."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)`` that has another; the root is the component's smallest node."""
    edges = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written_clean(edges.distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        down = _hung(large)  # every v is below its u
        small = down.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(down.select("u", F.col("low").alias("v")))
        edges = written_clean(small.where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
