"""Spectrum graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE, SINK = -1, -2


def spectrum_edges(pairs: DataFrame, lower: DataFrame, upper: DataFrame, clusters: DataFrame, tolerance: float) -> DataFrame:
    """(spectrum, cluster_id, side, src, dst, weight) with side lower, upper or pivot.

    Of a pair with masses m1 < m2 and a pivot p: below p it is a lower edge; above p and below 2 (p + tolerance) an upper edge, from
    high to low; else a pivot edge. Boundaries hang on SOURCE, below p or between p and 2 (p + tolerance); the left ends of pivot
    edges lead the lower graph to SINK, their right ends the upper graph. Of several writers of an edge the last wins, by
    weight. Inputs: pairs (spectrum, pair_id, left_node, right_node, m1, m2), lower and upper (spectrum, bnd_id, node, mass[,
    cluster_id]), clusters (spectrum, cluster_id, point).
    """
    at = pairs.join(clusters, "spectrum")
    top = 2 * (F.col("point") + tolerance)
    side = F.when(F.col("m2") < F.col("point"), "lower").when((F.col("m1") > F.col("point")) & (F.col("m2") < top), "upper").otherwise("pivot")
    at = at.withColumn("side", side)
    forth = F.col("side") != "upper"
    inner = at.select("spectrum", "cluster_id", "side", F.when(forth, F.col("left_node")).otherwise(F.col("right_node")).alias("src"), F.when(forth, F.col("right_node")).otherwise(F.col("left_node")).alias("dst"), F.col("pair_id").alias("weight"))
    crossing = at.filter("side = 'pivot'")
    sinks = [crossing.select("spectrum", "cluster_id", F.lit(s).alias("side"), F.col(n).alias("src"), F.lit(SINK).cast("long").alias("dst"), F.lit(-1).cast("long").alias("weight")) for s, n in (("lower", "left_node"), ("upper", "right_node"))]
    low = lower.select("spectrum", "bnd_id", "node", "mass").join(clusters, "spectrum").filter(F.col("mass") < F.col("point"))
    high = upper.select("spectrum", "cluster_id", "bnd_id", "node", "mass").join(clusters, ["spectrum", "cluster_id"]).filter((F.col("mass") > F.col("point")) & (F.col("mass") < top))
    sources = [df.select("spectrum", "cluster_id", F.lit(s).alias("side"), F.lit(SOURCE).cast("long").alias("src"), F.col("node").alias("dst"), F.col("bnd_id").alias("weight")) for s, df in (("lower", low), ("upper", high))]
    edges = inner
    for more in (*sinks, *sources):
        edges = edges.unionByName(more)
    return edges.groupBy("spectrum", "cluster_id", "side", "src", "dst").agg(F.max("weight").alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Pivot edges in both directions."""
    pivot = edges.filter("side = 'pivot'").select("spectrum", "cluster_id", "src", "dst", "weight")
    return pivot.unionByName(pivot.select("spectrum", "cluster_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("spectrum", "cluster_id", "src", "dst").agg(F.max("weight").alias("pair_id"))


def ends(edges: DataFrame, key: list[str], sinks: bool) -> DataFrame:
    """Nodes without incoming (sources) or outgoing (sinks) edges."""
    has, lacks = ("dst", "src") if sinks else ("src", "dst")
    return edges.select(*key, F.col(has).alias("node")).distinct().join(edges.select(*key, F.col(lacks).alias("node")).distinct(), [*key, "node"], "left_anti")


def order(edges: DataFrame, key: list[str]) -> DataFrame:
    return edges.groupBy(*key).agg((F.max(F.greatest("src", "dst")) + 1).alias("order"))
