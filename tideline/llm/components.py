"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a minimum per node and a join back to the edges: a node with very many neighbours is never gathered, and
the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch, u: str = "a", v: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component. No edges: no rows."""
    e = scratch.put(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v").distinct()
    )
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = _least_neighbour(large)
        small = (
            large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u > v").distinct()
        )
        old, e = e, scratch.put(small)
        scratch.drop(old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
