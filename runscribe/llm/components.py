"""Connected components of links between documents, by joins and sums alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stage


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): each linked node and the smallest node reachable from it.

    Each round every node points to its smallest neighbour or itself, chains of pointers are followed twice,
    and the links are drawn anew between what is pointed to.  The number of nodes in links at least halves a
    round, a star ends in one, and each round is a table of its own in the shared folder.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "cc-pointers")
        for _ in range(2):
            further = to.select(F.col("node").alias("to"), F.col("to").alias("further"))
            to = stage(to.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "cc-pointers")
        ends = to.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        moved = edges.join(ends, "a").select("ta", "b").join(ends.toDF("b", "tb"), "b")
        edges = stage(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-links")
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), "to")
            labels = stage(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
