"""Connected components of a graph of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseline.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node (the larger, or the smaller ones and itself) on the smallest.

    Neighbours are never gathered: the smallest comes from an aggregate, and each edge meets it in a
    join, so a node with very many neighbours is only a skewed key of a join.
    """
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        seen = edges.unionByName(back)
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = seen.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = seen.groupBy("a").agg(F.min("b").alias("least"))
        moved = seen.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node on an edge ``a``, ``b``.

    Each round is written to the shared folder. It ends when a round changes nothing; the number of
    rounds grows with the logarithm of a component's width, not with its size.
    """
    edges = saved(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = saved(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
