"""Connected components by contraction, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.storage import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its smallest node.

    Each round hooks every node to its smallest neighbour, shortens the paths
    and replaces the edges by those between different trees; rounds grow with
    the logarithm of the nodes. Every round is a written table.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = scratch.save(edges, f"{name}-edges-0")
    labels = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), f"{name}-labels-0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        up = edges.groupBy("a").agg(F.min("b").alias("to"))
        jump = up.select(F.col("a").alias("to"), F.col("to").alias("next"))
        up = scratch.save(up.join(jump, "to", "left").select("a", F.coalesce("next", "to").alias("to")), f"{name}-up-{turn}")
        to = lambda old, new: up.select(F.col("a").alias(old), F.col("to").alias(new))
        labels = scratch.save(labels.join(to("component", "higher"), "component", "left").select("node", F.coalesce("higher", "component").alias("component")), f"{name}-labels-{turn}")
        moved = edges.join(to("a", "a2"), "a", "left").join(to("b", "b2"), "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        edges = scratch.save(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges-{turn}")
        for old in ("edges", "labels"):
            scratch.drop(f"{name}-{old}-{turn - 1}")
        scratch.drop(f"{name}-up-{turn - 1}")
    return labels
