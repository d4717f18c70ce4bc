"""Connected groups of linked things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.functions.stages import written


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), numbers that should be hashes; connected nodes have one root.

    Each round every node moves to the smallest of itself and its neighbours, and links between nodes that met go. With
    hashed numbers a constant share of the nodes goes per round, on long chains and around hubs as well. Only row
    counts reach the driver."""
    def moves(edges: DataFrame) -> DataFrame:
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))
        return written(edges.select(F.inline(ends)).groupBy("node").agg(F.least("node", F.min("other")).alias("root")))

    edges = written(links.select("a", "b").where("a <> b").distinct())
    roots = step = moves(edges)
    while True:
        a, b = (step.select(F.col("node").alias(end), F.col("root").alias(f"to_{end}")) for end in "ab")
        met = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        edges = written(met.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if edges.isEmpty():
            return roots
        step = moves(edges)
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
