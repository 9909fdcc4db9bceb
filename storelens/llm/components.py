"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.session import stage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node that each node reaches.

    Nodes without an edge don't occur. Each round links every neighbour of a node to its smallest
    neighbour, first the larger ones, then the smaller ones, until only stars around the smallest
    nodes are left. Minima are combined before the shuffle, and every round is a written table, so
    neither a hub's neighbours nor the graph are ever held in one place.
    """
    edges = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        before = tuple(state)
        # Larger neighbours go to the smallest of the node and its neighbours.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
        large = stage(large, "edges")
        # The node and its smaller neighbours go to the smallest of them.
        least = stage(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
        edges = stage(small.filter("a <> b").distinct(), "edges")
    raise RuntimeError(f"no stable components after {max_rounds} rounds")
