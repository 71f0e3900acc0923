"""Searches for targets of several residues: a table of merged masses is searched, and only the hits are taken apart.

A target of k residues is one of a kind and k - 1 pair targets. There are hundreds of millions of combinations, but few masses: sums are merged
in whole QUANTUM after each step, so that the product is never built. A mass that was hit is taken apart from its end: every target of the last step
leaves a complement, which has to be a merged mass of k - 1 residues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.params import LOSSES
from ..functions.storage import materialize
from .bandjoin import band_join

QUANTUM = 1e-6
STATES = ["amino_ids", "left_loss_ids", "right_loss_ids", "mod_ids"]


def _quantised(mass: Column) -> Column:
    return F.rint(mass / F.lit(QUANTUM)).cast("long")


def merged(spark: SparkSession, kind: str, k: int) -> list[DataFrame]:
    """For 1 to ``k`` residues the distinct masses (q, in QUANTUM) of a target of ``kind`` and pair targets; bounded by the parameters alone."""
    pair = dims.targets(spark, "pair").select(_quantised(F.col("mass")).alias("step")).distinct().coalesce(1)
    out = [materialize(dims.targets(spark, kind).select(_quantised(F.col("mass")).alias("q")).distinct(), "merged")]
    for _ in range(k - 1):
        # some hundred rows on the right
        sums = out[-1].crossJoin(F.broadcast(pair)).select((F.col("q") + F.col("step")).alias("q")).distinct()
        out.append(materialize(sums, "merged"))
    return out


def expanded(masses: DataFrame, kind: str, levels: list[DataFrame]) -> DataFrame:
    """``masses`` (q) with every combination that gives them: (q, STATES, target, complexity).

    target is the exact sum; complexity counts whether any left loss, any right loss and any modification isn't null.
    """
    spark = masses.sparkSession
    some = {"left": F.col("l") != 0, "right": F.col("r") % len(LOSSES) != 0, "mod": F.col("m") != 0}
    todo = masses.select("q", F.col("q").alias("rest"), F.lit(0.0).alias("target"), *(F.array().cast("array<int>").alias(s) for s in STATES), *(F.lit(False).alias(n) for n in some))
    for level in range(len(levels), 0, -1):
        ids = [F.col(c).alias(a) for c, a in zip(("amino_id", "left_loss_id", "right_loss_id", "mod_id"), "alrm", strict=True)]
        step = dims.targets(spark, "pair" if level > 1 else kind).select(_quantised(F.col("mass")).alias("step"), "mass", *ids)
        if level > 1:  # some hundred targets, of which those stay whose complement is a mass of the residues before
            met = todo.crossJoin(F.broadcast(step)).withColumn("rest", F.col("rest") - F.col("step"))
            met = met.join(levels[level - 2].withColumnRenamed("q", "rest"), "rest", "left_semi")
        else:
            met = todo.join(F.broadcast(step), F.col("rest") == F.col("step"))
        states = [F.concat(F.array(c), s).alias(s) for c, s in zip("alrm", STATES, strict=True)]
        todo = met.select("q", "rest", (F.col("target") + F.col("mass")).alias("target"), *states, *((F.col(n) | flag).alias(n) for n, flag in some.items()))
    return todo.select("q", *STATES, "target", sum((F.col(n).cast("int") for n in some), F.lit(0)).alias("complexity"))


def find_multi(queries: DataFrame, value: str, kind: str, k: int, tolerance: float) -> DataFrame:
    """Rows of ``queries`` with each combination of ``k`` residues within ``tolerance`` of ``value``: (columns, STATES, target, complexity, cost).

    STATES are arrays of ``k`` ids, that of the kind first. cost is |value - target| (1 + complexity).
    """
    spark = queries.sparkSession
    levels = merged(spark, kind, k)
    # rounding moves a sum by half a quantum for each residue; the exact condition follows
    found = band_join(queries, levels[-1].select((F.col("q") * QUANTUM).alias("_mass"), "q"), value, "_mass", tolerance + k * QUANTUM)
    found = materialize(found.drop("_mass"), "multi-hits")
    states = materialize(expanded(found.select("q").distinct(), kind, levels), "multi-states")
    apart = F.abs(F.col(value) - F.col("target"))
    exact = (F.col("target") >= F.col(value) - F.lit(tolerance)) & (F.col("target") <= F.col(value) + F.lit(tolerance))
    return found.join(states, "q").filter(exact).withColumn("cost", apart * (1 + F.col("complexity"))).drop("q")
