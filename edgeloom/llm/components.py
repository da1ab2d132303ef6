"""Connected components by repeated contraction, without ever holding a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.session import Stage


def components(edges: DataFrame, stage: Stage, name: str = "cc", jumps: int = 2) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); the component is its smallest node.

    Each round points every node to its smallest neighbour (an aggregation with map-side combine), follows the pointers a few
    steps, and contracts the edges. Rounds end when no edge is left; their number grows with the logarithm of a component's
    width. All tables of a round are written, so joins on a much-linked node see two shuffled sides and can be split.
    """
    edges = stage.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}_edges_0")
    found, turn = None, 0
    while turn == 0 or not edges.isEmpty():
        turn += 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = stage.table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), f"{name}_points_{turn}_0")
        for jump in range(1, jumps + 1):
            ahead = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            points = stage.table(points.join(ahead, "to").select("node", F.col("next").alias("to")), f"{name}_points_{turn}_{jump}")
        if found is None:
            found = points.select("node", F.col("to").alias("component"))
        else:
            moved = points.select(F.col("node").alias("component"), "to")
            found = stage.table(found.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"{name}_found_{turn}")
        left, right = points.select(F.col("node").alias("a"), F.col("to").alias("l")), points.select(F.col("node").alias("b"), F.col("to").alias("r"))
        contracted = edges.join(left, "a").join(right, "b").where("l <> r").select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()
        edges = stage.table(contracted, f"{name}_edges_{turn}")
    return found
