"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from effortlens.llm.storage import stored


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges (a, b) -> (node, label): label is the smallest node of the component.

    In each round every node points to its smallest neighbour if that is smaller (an aggregate with
    map-side combining, so a hub costs no more than its edges), pointers are followed once more,
    and edges are drawn anew between what their ends point to; edges that have shrunk to a point
    go. A star is done after one round, and only edges that are left travel in the next. The
    smallest node of a component never moves. Nulls and loops make no edge; an empty table gives
    no nodes.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if left.isEmpty():
            return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("near")), "near")
        onward = near.select(F.col("node").alias("near"), F.col("near").alias("label"))
        moved = stored(near.join(onward, "near").select("node", "label"), "moved")
        if labels is None:
            labels = moved
        else:
            step = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = stored(labels.join(step, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
        at_a = moved.select(F.col("node").alias("a"), F.col("label").alias("x"))
        at_b = moved.select(F.col("node").alias("b"), F.col("label").alias("y"))
        drawn = left.join(at_a, "a").join(at_b, "b").where("x <> y")
        left = stored(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
