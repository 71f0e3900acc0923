"""Labels of peaks: fragment nodes, grouping by peak, comparison of two labellings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import first_match, quantised
from .symmetry import list_matches

NODE_TOLERANCE = 0.01


def fragments(peaks: DataFrame, pairs: DataFrame, lower: DataFrame, upper: DataFrame, quads: DataFrame, paired: DataFrame) -> DataFrame:
    """The union of all labelled peaks with their node: (spectrum, src, cluster_id, slot, peak_id, charge, cost, loss_id, mod_id, node_mass).

    Pairs give both ends, with the left and the right loss; pivots and symmetries have charge 1, no loss and no cost (infinity).
    A node is a fragment mass, m/z times charge, up to NODE_TOLERANCE. Inputs: pairs (spectrum, left_peak, right_peak,
    left_charge, right_charge, cost, left_loss_id, right_loss_id, mod_id), lower and upper (spectrum[, cluster_id], peak_id, charge,
    cost, right_loss_id, mod_id), quads and paired (spectrum, cluster_id, slot, peak_id).
    """
    none = F.lit(None).cast("int")
    ends = [
        pairs.select("spectrum", F.lit("pair").alias("src"), none.alias("cluster_id"), F.lit(s).alias("slot"), F.col(f"{side}_peak").alias("peak_id"), F.col(f"{side}_charge").alias("charge"), "cost", F.col(f"{side}_loss_id").alias("loss_id"), (F.col("mod_id") if s else none).alias("mod_id"))
        for s, side in enumerate(("left", "right"))
    ]
    one = [
        df.select("spectrum", F.lit(src).alias("src"), (F.col("cluster_id") if "cluster_id" in df.columns else none).alias("cluster_id"), F.lit(0).alias("slot"), "peak_id", "charge", "cost", F.col("right_loss_id").alias("loss_id"), "mod_id")
        for src, df in (("lower", lower), ("upper", upper))
    ]
    null = [
        df.select("spectrum", F.lit(src).alias("src"), "cluster_id", "slot", "peak_id", F.lit(1).alias("charge"), F.lit(float("inf")).alias("cost"), F.lit(0).alias("loss_id"), F.lit(0).alias("mod_id"))
        for src, df in (("pivot", quads), ("symmetry", paired))
    ]
    union = reduce(DataFrame.unionByName, [*ends, *one, *null])
    return union.join(peaks.select("spectrum", "peak_id", "mz"), ["spectrum", "peak_id"]).withColumn("node_mass", F.col("mz") * F.col("charge")).drop("mz")


def pair_ends(pairs: DataFrame) -> DataFrame:
    """Both ends of each pair: (spectrum, peak_id, charge, cost, loss_id), with the left and the right loss. The pairs are made once."""
    ends = F.array(*(F.struct(F.col(f"{s}_peak").alias("peak_id"), F.col(f"{s}_charge").alias("charge"), "cost", F.col(f"{s}_loss_id").alias("loss_id")) for s in ("left", "right")))
    return pairs.select("spectrum", F.inline(ends))


def with_nodes(labels: DataFrame, tolerance: float = NODE_TOLERANCE, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """``node_id``: the rank, from 0, of the mass in steps of ``tolerance`` among its spectrum's."""
    order = W.partitionBy(*on).orderBy(quantised(F.col("node_mass"), tolerance))
    return labels.withColumn("node_id", F.dense_rank().over(order) - 1)


def by_peak(labels: DataFrame, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """A row for each labelled peak with its charges and losses, the cheapest label first."""
    ordered = F.sort_array(F.collect_list(F.struct("cost", "charge", "loss_id")))
    grouped = labels.groupBy(*on, "peak_id").agg(ordered.alias("l"))
    return grouped.select(*on, "peak_id", F.transform("l", lambda x: x["charge"]).alias("charges"), F.transform("l", lambda x: x["loss_id"]).alias("losses"), F.get("l", F.lit(0))["cost"].alias("cost"))


def compared(one: DataFrame, two: DataFrame, tolerance: float = 1e-10, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """Peaks of two labellings (on, idx, mz, series, position, charges, losses; idx ascends with m/z) that align, and how they agree.

    int_err is the difference of intensities, where both sides have that column. charge_aln and loss_aln are the first common entries.
    """
    both = ["intensity"] if "intensity" in one.columns and "intensity" in two.columns else []
    joined = list_matches(one, two, on, "mz", "idx", tolerance, ("mz", "series", "position", "charges", "losses", *both))
    return joined.select(
        *on, "idx", "other_idx", (F.col("mz") - F.col("other_mz")).alias("mz_diff"), (F.col("series") == F.col("other_series")).alias("series_err"),
        (F.col("position") - F.col("other_position")).alias("pos_err"), first_match(F.col("charges"), F.col("other_charges")).alias("charge_aln"), first_match(F.col("losses"), F.col("other_losses")).alias("loss_aln"),
        *((F.col(c) - F.col(f"other_{c}")).alias("int_err") for c in both),
    )


def compared_spectra(one: DataFrame, two: DataFrame, aligned: DataFrame, on: tuple[str, ...] = ("spectrum",), also: Sequence[Column] = ()) -> DataFrame:
    """(on, pivot_err, peptide_err, mz_err, also) of spectra (on, peptide, pivot, n peaks): the peptides' edit distance, and peaks of ``one`` that don't align.

    ``also``: named aggregates of a spectrum's aligned peaks, null without any. A row for each spectrum is never broadcast: Spark takes what is expanded from a small file for small.
    """
    held = aligned.groupBy(*on).agg(F.count("*").alias("n_aligned"), *also)
    both = one.select(*on, "peptide", "pivot", "n").join(two.select(*on, F.col("peptide").alias("other"), F.col("pivot").alias("other_pivot")).hint("merge"), list(on)).join(held.hint("merge"), list(on), "left")
    rest = [c for c in held.columns if c not in (*on, "n_aligned")]
    return both.select(*on, (F.col("pivot") - F.col("other_pivot")).alias("pivot_err"), F.levenshtein("peptide", "other").alias("peptide_err"), (F.col("n") - F.coalesce("n_aligned", F.lit(0))).alias("mz_err"), *rest)
