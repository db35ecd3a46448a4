"""Connected components by alternating stars over an edge table.

Each round attaches every node's larger neighbours to its smallest one, first seen from below, then from above; it
ends when no edge changes, after a number of rounds that grows with the logarithm of the longest chain.
No neighbour list is ever gathered: a round is a minimum per node and a join back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """(a, b) with a > b. Larger: link the larger neighbours to the minimum; else the smaller ones and the node."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of undirected ``edges`` (a, b). Nodes without an edge to
    another node are left out."""
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        count, total = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == seen or not count:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (count, total)
        current = stored(_star(_star(current, True), False), "edges")
