"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askgrid.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that it is connected to) of all nodes of `edges` (a, b: long).

    By contraction: each node hooks onto its least neighbour if that is less than itself, takes that
    one's hook in turn, and the edges between what is then one node go. Each round at least halves the
    nodes that still have an edge. Tables are written each round, so lineage stays short; minima are
    taken before the shuffle, and joins have one row per key on one side. Edges may repeat, in either
    direction; loops are left out. No edges: no rows.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialise(edges.where("a != b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b"))
        hooks = materialise(hooks.select(F.col("a").alias("node"), F.least("a", "b").alias("hook")), "hooks")
        of_hook = hooks.select(F.col("node").alias("hook"), F.col("hook").alias("further"))
        hooks = materialise(hooks.join(of_hook, "hook").select("node", F.col("further").alias("hook")), "hooks")
        if roots is None:
            roots = hooks.select("node", F.col("hook").alias("root"))
        else:
            further = hooks.select(F.col("node").alias("root"), "hook")
            roots = roots.join(further, "root", "left").select("node", F.coalesce("hook", "root").alias("root"))
            roots = materialise(roots, "roots")
        for end in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(end), "hook"), end)
            edges = edges.drop(end).withColumnRenamed("hook", end)
        edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialise(edges.where("a != b").distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
