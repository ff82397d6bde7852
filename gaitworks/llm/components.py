"""Connected components of a table of links, by contraction with random priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaitworks.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node that can be reached) for every node of ``links`` (``a long, b long``).

    Each round every node points at the neighbour, or itself, with the least
    hash of that round, and the graph is contracted along the pointers: a
    constant share of the nodes goes each round, stars and cliques in one. A
    hub's links are only ever summed (a least value, before they travel) and
    joined with one row. Every round's tables are stored, so a lost executor
    costs no earlier round. Links of a node with itself, repeated links and
    empty tables are fine.
    """
    label = "components"
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), label)
    labels: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), "b")).alias("best"))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("b"))
        points = stored(ranked.select("a", F.least("best", own)["b"].alias("p")), label)
        jump = points.select(F.col("a").alias("p"), F.col("p").alias("q"))
        step = stored(points.join(jump, "p").select("a", F.col("q").alias("p")), label)
        if labels is None:
            labels = step.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            moved = labels.join(step, labels["root"] == step["a"], "left")
            labels = stored(moved.select("node", F.coalesce("p", "root").alias("root")), label)
        first = edges.join(step, "a").select(F.col("p").alias("x"), "b")
        second = first.join(step.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
        edges = stored(second.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
