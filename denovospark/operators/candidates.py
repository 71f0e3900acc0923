"""Affixes, their pairing about the pivot, and candidate sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import edge_disjoint


def orientation(symbols: Column, b: str = "b", y: str = "y") -> Column:
    """From the loss symbols of an affix's last step: (kind, at). prefix if one has b and not y, suffix the other way, both alike; else infix, -1."""
    words = lambda s: F.split(s, " ")
    has = lambda s, x: F.array_contains(words(s), x)
    first = lambda own, other: F.array_position(F.transform(symbols, lambda s: has(s, own) & ~has(s, other)), True) - 1
    prefix, suffix = first(b, y), first(y, b)
    return F.array_compact(F.array(
        F.when(prefix >= 0, F.struct(F.lit("prefix").alias("kind"), prefix.cast("int").alias("at"))), F.when(suffix >= 0, F.struct(F.lit("suffix").alias("kind"), suffix.cast("int").alias("at"))),
        F.when((prefix < 0) & (suffix < 0), F.struct(F.lit("infix").alias("kind"), F.lit(-1).alias("at"))),
    ))


def oriented(affixes: DataFrame, symbols: str = "symbols") -> DataFrame:
    return affixes.withColumn("_o", F.explode(orientation(F.col(symbols)))).withColumn("kind", F.col("_o.kind")).withColumn("at", F.col("_o.at")).drop("_o")


def pair_affixes(prefixes: DataFrame, suffixes: DataFrame, pivot_edges: DataFrame, on: list[str]) -> DataFrame:
    """Prefixes (on, prefix_id, cost, lower, upper) with suffixes that begin across the pivot.

    A prefix that begins at (u, w) meets a suffix that begins at (x, v) if u-v and w-x are pivot edges; both halves may not
    be one affix nor share an edge. The nodes are matched before the paths are joined to them.
    """
    head = lambda c: F.element_at(F.col(c), 1)
    p = prefixes.select(*on, "prefix_id", F.col("cost").alias("prefix_cost"), F.col("lower").alias("p_lower"), F.col("upper").alias("p_upper")).withColumn("u", head("p_lower")).withColumn("w", head("p_upper"))
    s = suffixes.select(*on, "suffix_id", F.col("cost").alias("suffix_cost"), F.col("lower").alias("s_lower"), F.col("upper").alias("s_upper")).withColumn("x", head("s_lower")).withColumn("v", head("s_upper"))
    one = pivot_edges.select(*on, F.col("src").alias("u"), F.col("dst").alias("v"), F.col("pair_id").alias("pair_uv"))
    two = pivot_edges.select(*on, F.col("src").alias("w"), F.col("dst").alias("x"), F.col("pair_id").alias("pair_wx"))
    heads = p.select(*on, "u", "w").distinct().join(one, [*on, "u"]).join(two, [*on, "w"]).join(s.select(*on, "x", "v").distinct(), [*on, "x", "v"], "left_semi")
    met = p.join(heads, [*on, "u", "w"]).join(s, [*on, "x", "v"])
    apart = edge_disjoint(F.col("p_lower"), F.col("s_lower")) & edge_disjoint(F.col("p_upper"), F.col("s_upper"))
    return met.filter((F.col("prefix_id") != F.col("suffix_id")) & apart)


def best_pivot(observed: DataFrame, pivots: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """For each row of ``observed`` (on, key, mass) the pivot of its cluster (on, pivot_idx, pivot) nearest to half of its mass; the first on ties."""
    both = observed.join(pivots, on).withColumn("offset", F.col("mass") - 2 * F.col("pivot"))
    order = W.partitionBy(*on, *key).orderBy(F.abs("offset"), "pivot_idx")
    return both.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def sequences(paired: DataFrame, prefix_steps: DataFrame, suffix_steps: DataFrame, pivot_steps: DataFrame, on: list[str]) -> DataFrame:
    """Candidates (on, prefix_id, suffix_id, sequence, cost, mass): the prefix reversed, the pivot's residue, the suffix.

    *_steps hold residues: (on, affix id, step, rank, symbol, mass) with the cheapest annotation of a step at rank 0; pivot_steps (on, pair_id,
    symbol, mass, cost), likewise one row a pair. Step 0 is next to the pivot and was counted by it.
    """
    def spelled(steps: DataFrame, key: str, back: bool) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("step", "symbol", "mass")), asc=not back)
        return steps.filter("rank = 0 and step > 0").groupBy(*on, key).agg(ordered.alias("s")).select(*on, key, F.array_join(F.transform("s", lambda x: x["symbol"]), "").alias(f"{key}_text"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["mass"]).alias(f"{key}_mass"))

    joined = paired.join(spelled(prefix_steps, "prefix_id", True), [*on, "prefix_id"], "left").join(spelled(suffix_steps, "suffix_id", False), [*on, "suffix_id"], "left")
    joined = joined.join(pivot_steps.select(*on, F.col("pair_id").alias("pair_uv"), F.col("symbol").alias("pivot_text"), F.col("mass").alias("pivot_mass"), F.col("cost").alias("pivot_cost")), [*on, "pair_uv"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.select(
        *on, "prefix_id", "suffix_id", F.concat_ws("", "prefix_id_text", "pivot_text", "suffix_id_text").alias("sequence"),
        (F.col("prefix_cost") + F.col("pivot_cost") + F.col("suffix_cost")).alias("cost"), ((zero("prefix_id_mass") + F.col("pivot_mass") + zero("suffix_id_mass")) / 2).alias("mass"),
    )


def top(candidates: DataFrame, n: int, on: list[str]) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy(*on).orderBy("cost", "sequence")) - 1).filter(F.col("rank") < n)
