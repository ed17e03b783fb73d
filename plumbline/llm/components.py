"""Connected components of an edge table by contraction, every round a few joins and partial aggregations.

Each round every node looks two edges far for the smallest node in an order drawn anew from the round's number, follows the
pointers found twice, and the edges are contracted to the nodes pointed to. A random order shrinks chains as well as stars.
A hub's edges meet in partial aggregations and plain joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, release


def _place(c: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that it reaches."""
    edges = materialize(edges.select("a", "b").where("a != b").distinct(), "components-edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(steps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(_place("b", turn)).alias("m")).select("a", F.least(F.col("m"), _place("a", turn)).alias("m"))
        far = both.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("far"))
        to = near.join(far, "a").select("a", F.least("m", "far")["id"].alias("to"))
        for _ in range(2):
            to = to.join(to.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", F.col("next").alias("to"))
        to = materialize(to, "components-step")
        steps.append(to)
        left = edges.join(to, "a").select(F.col("to").alias("a2"), "b")
        left = left.join(to.withColumnRenamed("a", "b"), "b").select(F.col("a2").alias("a"), F.col("to").alias("b"))
        contracted, done = left.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), edges
        edges = materialize(contracted, "components-edges")
        release(done)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = steps[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for to in steps[1:]:
        labels = labels.join(to.select(F.col("a").alias("root"), F.col("to").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    labels = materialize(labels, "components-roots")
    release(edges, *steps)
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")


def extended(cells: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b): only cells that the links touch are worked on."""
    if cells is None:
        return components(links)
    for side in ("a", "b"):
        links = links.join(cells.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    merged = materialize(components(links.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))), "components-merged")
    moved = cells.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    # a node without a cell so far is its own cell in `merged`
    return moved.unionByName(merged.join(cells.select("node"), "node", "left_anti"))
