"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges that a task of a round has, about, and tasks at least.
TASK_EDGES, TASKS = 50_000, 8


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), where root is the component's least node.

    Alternates the large-star and small-star operations, each an aggregate and a join, until the links are stars around
    the roots. Every round is written to the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20, 0)"))).first()
    held = state(edges)
    # small tables in few tasks: rounds are many, and most of them short
    tasks = max(TASKS, 2 * held[0] // TASK_EDGES)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: a node's larger neighbours are linked with its least neighbour
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # small star: its smaller neighbours, and the node itself
        large = materialize(large.coalesce(tasks).distinct().coalesce(tasks), "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct()
        after = materialize(after.coalesce(tasks), "cc-edges")
        discard(large, edges)
        edges, before, held = after, held, state(after)
        if held == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
