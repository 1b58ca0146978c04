"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.shared import stage


def contract(edges: DataFrame) -> DataFrame | None:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    In each round every node points to its least neighbour, if that is smaller, and one step
    further; edges between different targets stay for the next round.  Rounds grow with the
    logarithm of the longest chain.  Each round's tables are written, so lineage stays short.
    """
    edges = stage(edges.where("a <> b").select("a", "b"), "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = stage(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("root")), "parents")
        left, right = (parent.select(F.col("node").alias(k), F.col("root").alias(f"to_{k}")) for k in "ab")
        edges = stage(edges.join(left, "a").join(right, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b").distinct(), "edges")
        if mapping is None:
            mapping = parent
        else:
            further = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            mapping = stage(mapping.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    return mapping
