"""Connected components of an edge table by contraction: hook to the smallest neighbour, jump pointers, relabel edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.store import drop, materialize


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping on a (v, c) forest with c < v until every c is a root."""
    while True:
        up = parent.select(F.col("v").alias("c"), F.col("c").alias("up"))
        new = materialize(parent.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"), F.col("up").isNotNull().alias("moved")))
        moved = not new.filter("moved").isEmpty()
        parent = new.select("v", "c")
        if not moved:
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of ``edges`` (a, b: long) that isn't its component's smallest: c is that smallest one.

    Each round every vertex with a smaller neighbour takes the smallest as its parent; parents only decrease, so they
    form a forest, whose depth pointer jumping halves. Edges are relabelled by roots and loops fall away, so vertices
    at least halve each round. Stars of any size cost one round: partial aggregation meets a hot centre first.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        parent = _flatten(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("c")))
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("v").alias("c"), F.col("c").alias("up"))
            moved = labels.join(up, "c", "left").select("v", F.coalesce("up", "c").alias("c"))
            labels = materialize(moved.unionByName(parent.join(labels.select("v"), "v", "left_anti")))
        a = parent.select(F.col("v").alias("a"), F.col("c").alias("ra"))
        b = parent.select(F.col("v").alias("b"), F.col("c").alias("rb"))
        near = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        old, edges = edges, materialize(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct())
        drop(old)
    return edges.select(F.col("a").alias("v"), F.col("b").alias("c")) if labels is None else labels
