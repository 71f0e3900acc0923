"""Cheap paths through the product graph, and their annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import materialize
from .product import KEY, least_costs

NODE = [*KEY, "low", "up"]


def rests(product: DataFrame) -> DataFrame:
    """(spectrum, cluster_id, low, up, dist): the least cost of the edges from a source of the product graph to each node."""
    edges = product.select(*KEY, F.col("src_low").alias("low"), F.col("src_up").alias("up"), "dst_low", "dst_up", "cost")
    heads = edges.select(*KEY, F.col("dst_low").alias("low"), F.col("dst_up").alias("up"))
    start = edges.select(*NODE).distinct().join(heads, NODE, "left_anti").withColumn("dist", F.lit(0.0))
    onward = lambda changed: changed.join(edges, NODE).select(*KEY, F.col("dst_low").alias("low"), F.col("dst_up").alias("up"), (F.col("dist") + F.col("cost")).alias("dist"))
    return least_costs(start, onward, NODE, "path-rests")


def trace(product: DataFrame, limit: float, most: int | None = None) -> DataFrame:
    """(spectrum, cluster_id, path_id, cost, lower, upper): paths from the ends of the product graph back to its sources, cheapest first.

    All walks of two nodes or more whose edges cost less than ``limit`` together. Edges are followed against their direction, so the first nodes
    after the virtual one are next to the pivot. A walk goes on only where its cost and the exact rest, the least cost from there to a source, stay under
    the limit: no walk is made that can't end. A level of all walks is one join on their last nodes. The graph has no cycles, as masses
    rise along its edges. With ``most``, more walks of a cluster than that raise ValueError: nothing is left out silently.
    """
    product = materialize(product.select(*KEY, "src_low", "src_up", "dst_low", "dst_up", "cost"), "path-edges")
    rest = rests(product)
    sources = product.select(*KEY, "src_low", "src_up").distinct().join(product.select(*KEY, F.col("dst_low").alias("src_low"), F.col("dst_up").alias("src_up")), [*KEY, "src_low", "src_up"], "left_anti")
    of_source = rest.select(*KEY, F.col("low").alias("src_low"), F.col("up").alias("src_up"), F.col("dist").alias("rest"))
    back = product.join(of_source, [*KEY, "src_low", "src_up"]).join(sources.withColumn("_source", F.lit(True)), [*KEY, "src_low", "src_up"], "left")
    # sums in another order may differ in their last digits; the exact condition is that on the cost itself
    slack = F.lit(limit + 1e-9)
    back = back.filter(F.col("cost") + F.col("rest") < slack)
    back = materialize(back.select(*KEY, F.col("dst_low").alias("low"), F.col("dst_up").alias("up"), "src_low", "src_up", F.col("cost").alias("along"), "rest", F.col("_source").isNotNull().alias("ends")), "path-back")
    starts = back.select(*NODE).distinct().join(product.select(*KEY, F.col("src_low").alias("low"), F.col("src_up").alias("up")), NODE, "left_anti")
    walks = starts.select(*NODE, F.lit(0.0).alias("cost"), F.array("low").alias("lower"), F.array("up").alias("upper"))
    done = []
    while True:
        cost = F.col("cost") + F.col("along")
        longer = walks.join(back, NODE).filter((cost + F.col("rest") < slack) & (cost < limit))
        longer = longer.select(*KEY, F.col("src_low").alias("low"), F.col("src_up").alias("up"), cost.alias("cost"), F.array_append("lower", F.col("src_low")).alias("lower"), F.array_append("upper", F.col("src_up")).alias("upper"), "ends")
        longer = materialize(longer, "path-walks")
        done.append(longer.filter("ends"))
        if longer.isEmpty():
            break
        walks = longer.filter("not ends").drop("ends")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    order = W.partitionBy(*KEY).orderBy("cost", F.arrays_zip("lower", "upper"))
    found = found.withColumn("path_id", F.row_number().over(order).cast("long") - 1)
    if most is not None and not found.filter(F.col("path_id") >= most).isEmpty():
        raise ValueError(f"more than {most} paths: lower the cost threshold")
    return found.select(*KEY, "path_id", "cost", "lower", "upper")


def steps(paths: DataFrame) -> DataFrame:
    """(spectrum, cluster_id, path_id, step, src_low, src_up, dst_low, dst_up): consecutive nodes of each path."""
    at = paths.select("spectrum", "cluster_id", "path_id", F.posexplode(F.arrays_zip("lower", "upper")).alias("step", "n"))
    order = W.partitionBy("spectrum", "cluster_id", "path_id").orderBy("step")
    nxt = at.withColumn("m", F.lead("n").over(order)).filter("m is not null")
    return nxt.select("spectrum", "cluster_id", "path_id", "step", F.col("n.lower").alias("src_low"), F.col("n.upper").alias("src_up"), F.col("m.lower").alias("dst_low"), F.col("m.upper").alias("dst_up"))


def cheapest_first(annotated: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """``rank`` from 0 of each annotation of an edge by cost, ties by ``ties``."""
    return annotated.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("cost", *ties)) - 1)
