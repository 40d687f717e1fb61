"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkaudit.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``links`` (``a``, ``b``); the component is its smallest id.

    Each round sends every vertex to the smallest vertex two steps away, counting only its smallest
    neighbour, and goes on with the links between what remains. Linked vertices stay linked or
    become one, so a component ends as its smallest vertex; the links shrink with every round.
    All steps are grouped sums and joins on a vertex: a vertex with very many links is summed up
    before the shuffle, and its joins are split by Spark's skew handling. Each round is written to
    the shared folder. Null ends are no links. An empty table gives an empty result.
    """
    links = links.where(F.col("a") != F.col("b"))
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
        parent = stored(both.groupBy("id").agg(F.least("id", F.min("near")).alias("up")), "parents")
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("to"))
        jump = stored(parent.join(above, "up").select("id", "to"), "jumps")
        if labels is None:
            labels = jump.withColumnRenamed("to", "component")
        else:
            moved = jump.select(F.col("id").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = stored(labels, "labels")
        at_a = jump.select(F.col("id").alias("a"), F.col("to").alias("to_a"))
        at_b = jump.select(F.col("id").alias("b"), F.col("to").alias("to_b"))
        ends = edges.join(at_a, "a").join(at_b, "b").where(F.col("to_a") != F.col("to_b"))
        edges = stored(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
