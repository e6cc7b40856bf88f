"""Connected components of a large edge table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, materialize


def _lowest_neighbours(pairs: DataFrame) -> DataFrame:
    """u, m (the lowest of u and its neighbours) and n (how many neighbours u has)."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return m.select("u", F.least("u", "m").alias("m"), "n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the lowest node that links reach) of every node on an edge.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its lowest neighbour, then its smaller neighbours and itself.
    Each round needs O(edges) rows, and the number of rounds grows with the
    logarithm of the longest path. A node with very many neighbours is joined by
    broadcast (heavy_join), so that it never lands in one task.
    Null nodes and loops are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} != {b}")
    e = materialize(e.distinct(), "edges")
    total = e.count()
    while total:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(_lowest_neighbours(both), "low")
        # larger neighbours of u go to u's lowest neighbour
        up = heavy_join(e.select(F.col("v").alias("u"), F.col("u").alias("x")), low, "u", "n", 2 * total)
        big = materialize(up.select(F.col("x").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        # smaller neighbours of u, and u, go to the lowest of them
        low2 = materialize(big.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        down = heavy_join(big, low2, "u", "n", total)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        small = materialize(small, "edges")
        # done when every node has one edge, to a node that has none downward
        shape = small.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        roots = small.select(F.col("v").alias("u")).distinct().join(small.select("u"), "u", "left_semi").limit(1).count()
        e, total = small, shape["n"]
        if shape["n"] == shape["nodes"] and not roots:
            break
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
