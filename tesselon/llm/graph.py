"""Connected components of edge tables, by contraction.

Each round every node takes the smallest id among itself and its neighbours, edges are relabelled and merged, and the
labels of all nodes follow. A round at least halves the nodes that have edges. Every round's tables are written to the
shared folder, so plans stay short and a lost executor costs one round at most. Nodes of many edges are met by partial
aggregation and by joins whose skewed partitions Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import common


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of comparable ids -> saved table (node, component) of every node with an edge; component is the least id reachable."""
    edges = common.save(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.save(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "least")
        # one jump more: the label of the label
        jump = least.alias("x").join(least.select(F.col("node").alias("to"), F.col("to").alias("far")), "to", "left")
        least2 = common.save(jump.select("node", F.coalesce("far", "to").alias("to")), "least")
        common.drop(least)
        a, b = least2.select(F.col("node").alias("a"), F.col("to").alias("a2")), least2.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        new_edges = common.save(moved, "edges")
        if labels is None:
            new_labels = least2.select("node", F.col("to").alias("component"))
            labels, kept = new_labels, least2
        else:
            on = labels.join(least2.select(F.col("node").alias("component"), F.col("to").alias("far")), "component", "left")
            new = common.save(on.select("node", F.coalesce("far", "component").alias("component")), "labels")
            common.drop(kept)
            common.drop(least2)
            labels, kept = new, new
        common.drop(edges)
        edges = new_edges
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
