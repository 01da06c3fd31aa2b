"""Connected components of a distributed graph.

Alternating star contraction: large-star links every larger neighbour of a node to the smallest
node it knows, small-star links a node's smaller neighbours there too. Both keep components as they
are, and the rounds end when no link changes: each component is then a star around its smallest
node. Every round is two aggregations and two joins on light rows, written to the shared folder; the
neighbours of a hub, which may be a third of all nodes, are joined where they are. No link reaches
the driver, only counts do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_counted, materialize


def _to_least(links: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (u, v) with m, the least of u and of u's v in links."""
    least = links.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least = materialize(least.select("w", F.least("w", "m").alias("m"), "n"), "least")
    return join_counted(rows, least, [("u", "w")], "n")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link.

    Direction, repeats and loops don't matter; rows with a null end are no links. The rounds, in the
    order of the logarithm of the longest path, go on until nothing changes. An empty table gives an
    empty one.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u > v").distinct()
    now = materialize(now, "links")
    last = None
    while True:
        # Large star: from each node u, its larger neighbours go to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, both.where("v > u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        # Small star: from each node u, it and its smaller neighbours go to the least of them.
        small = _to_least(large, large)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        now = materialize(small.where("u > v").distinct(), "links")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
