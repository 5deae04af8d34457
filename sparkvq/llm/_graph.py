"""Connected components of an edge table, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored, unlink

#: Far beyond the logarithm of any number of nodes.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the component's smallest node.

    Alternating large-star and small-star steps: each replaces edges by edges to a
    smaller neighbour, their number never grows beyond that of the edges and nodes, and they end as stars.
    Each round is written to the shared folder, so lineage stays short and no executor is needed twice.
    """
    now = stored(edges.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b").distinct(), "edges", small=True)
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = stored(large.join(small, "a").selectExpr("b a", "m b").unionByName(small.selectExpr("a", "m b")).where("a <> b").distinct(), "edges", small=True)
        unlink(now)
        now = after
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    roots = now.selectExpr("a node", "b root")
    return roots.unionByName(roots.selectExpr("root node", "root").distinct())
