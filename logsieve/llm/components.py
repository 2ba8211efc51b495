"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` has two long columns.  Returns node, root (the smallest node of its component) for
    every node of an edge.  Each round takes the smallest root among a node's neighbours,
    then that root's own root, so that long chains halve; rounds go on until none changes.
    Only the number of changes comes to the driver."""
    a, b = edges.columns
    both = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
               .unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct())
    roots = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = (both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("r").alias("m")))
        best = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = cut(best.join(jump, "root").select("node", "old", F.least("root", "up").alias("root")))
        changed = new.filter("old <> root").count()
        roots = new.select("node", "root")
        if not changed:
            return roots
