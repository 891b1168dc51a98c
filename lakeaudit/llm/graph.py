"""Connected components by contraction, for near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.text import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); root is one node of the component, the same for all of it.

    In each round every node points at its neighbour (or itself) of least rank, and the graph is contracted along those
    pointers until no edge is left. The rank is a fresh hash each round, so that a round takes a fixed share of the nodes
    away, whatever the shape of the component; but for the first round, where it is the node itself: callers give their
    edges as stars around the least node, and those are settled at once. Whether edges are left is all that reaches the
    driver. Empty edges give no rows.
    """
    both = edges.where("a <> b").select("a", "b")
    graph = durable(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps: list[DataFrame] = []
    while not graph.isEmpty():
        turn = len(steps)
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn)) if turn else F.col(c)  # noqa: B023, E731
        least = graph.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(rank("a").alias("h"), F.col("a").alias("v"))
        to = durable(least.select(F.col("a").alias("node"), F.least(F.col("m"), own)["v"].alias("root")))
        moved = graph.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        graph = durable(moved.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        steps.append(to)
    if not steps:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    known = steps[0]
    for to in steps[1:]:
        known = known.join(to.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return durable(known) if len(steps) > 1 else known
