"""Dimension tables and the target masses that are built from them by cross joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import params as P


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows in one partition, so that cross joins of them stay in one."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def aminos(spark: SparkSession) -> DataFrame:
    return _table(spark, [(i, s, m) for i, (s, m) in enumerate(P.AMINOS)], "amino_id int, amino string, mass double")


def mods(spark: SparkSession, reflect: bool = False) -> DataFrame:
    """Modifications; reflected ones take their mass away."""
    sign = -1.0 if reflect else 1.0
    return _table(spark, [(i, s, sign * m if m else 0.0, i == 0) for i, (s, m) in enumerate(P.MODS)], "mod_id int, mod string, mass double, is_null boolean")


def mod_applicability(spark: SparkSession) -> DataFrame:
    return _table(spark, [(a, m) for a in range(len(P.AMINOS)) for m in [0, *P.MODS_OF.get(a, [])]], "amino_id int, mod_id int")


def loss_applicability(spark: SparkSession) -> DataFrame:
    return _table(spark, [(a, m) for a in range(len(P.AMINOS)) for m in [0, *P.LOSSES_OF.get(a, [])]], "amino_id int, loss_id int")


def trivial_losses(spark: SparkSession) -> DataFrame:
    return _table(spark, [(0, "", 0.0, True)], "loss_id int, loss string, mass double, is_null boolean")


def pair_losses(spark: SparkSession) -> DataFrame:
    return _table(spark, [(i, s, m, i == 0) for i, (s, m) in enumerate(P.LOSSES)], "loss_id int, loss string, mass double, is_null boolean")


def boundary_losses(spark: SparkSession, reflect: bool = False) -> DataFrame:
    """Every series with every loss; reflected, the series come in reverse order and the losses change sign."""
    series = list(reversed(P.SERIES)) if reflect else P.SERIES
    table = _table(spark, [(i, s, m) for i, (s, m) in enumerate(series)], "series_id int, series string, series_mass double")
    losses = pair_losses(spark)
    mass = F.col("series_mass") + F.col("mass") * (-1.0 if reflect else 1.0)
    return table.crossJoin(losses).select(
        (F.col("series_id") * len(P.LOSSES) + F.col("loss_id")).alias("loss_id"), F.trim(F.concat_ws(" ", "series", "loss")).alias("loss"), mass.alias("mass"), "is_null"
    )


def targets(spark: SparkSession, kind: str, conditional_losses: bool = False) -> DataFrame:
    """Target masses of ``kind`` pair, boundary or reflected: residue + left loss - right loss + modification.

    Losses apply to all residues, or with ``conditional_losses`` right losses to those that the applicability table names
    (compared by loss id within a series). ``complexity`` counts what isn't null: left loss, right loss, modification.
    """
    if kind not in ("pair", "boundary", "reflected"):
        raise ValueError(kind)
    reflect = kind == "reflected"
    left = pair_losses(spark) if kind == "pair" else trivial_losses(spark)
    right = pair_losses(spark) if kind == "pair" else boundary_losses(spark, reflect)
    base = aminos(spark).withColumnRenamed("mass", "amino_mass").join(F.broadcast(mod_applicability(spark)), "amino_id").join(F.broadcast(mods(spark, reflect).select("mod_id", F.col("mass").alias("mod_mass"), F.col("is_null").alias("mod_null"))), "mod_id")
    named = lambda df, side: df.select(F.col("loss_id").alias(f"{side}_loss"), F.col("mass").alias(f"{side}_mass"), F.col("is_null").alias(f"{side}_null"))
    full = base.crossJoin(named(left, "left")).crossJoin(named(right, "right"))
    if conditional_losses:
        allowed = loss_applicability(spark).select("amino_id", F.col("loss_id").alias("allowed"))
        full = full.join(F.broadcast(allowed), (full.amino_id == allowed.amino_id) & (F.col("right_loss") % len(P.LOSSES) == F.col("allowed"))).drop(allowed.amino_id).drop("allowed")
    mass = F.col("amino_mass") + F.col("left_mass") - F.col("right_mass") + F.col("mod_mass")
    complexity = sum((~F.col(c)).cast("int") for c in ("left_null", "right_null", "mod_null"))
    return full.select(F.lit(kind).alias("kind"), F.lit(1).alias("k"), mass.alias("mass"), "amino_id", F.col("left_loss").alias("left_loss_id"), F.col("right_loss").alias("right_loss_id"), "mod_id", complexity.alias("complexity"))


def ranked_targets(table: DataFrame) -> DataFrame:
    """``target_id``: the place by mass, ties by ids. A target table has hundreds of rows, whatever the data."""
    order = W.partitionBy("kind", "k").orderBy("mass", "amino_id", "left_loss_id", "right_loss_id", "mod_id")
    return table.withColumn("target_id", F.row_number().over(order) - 1)


def all_targets(spark: SparkSession) -> DataFrame:
    out = targets(spark, "pair")
    for kind in ("boundary", "reflected"):
        out = out.unionByName(targets(spark, kind))
    return ranked_targets(out)


def target_clusters(table: DataFrame, tolerance: float) -> DataFrame:
    """(kind, bucket, first, last, n): targets whose masses are equal in whole steps of ``tolerance``, as the span of their ``target_id``."""
    bucket = (F.col("mass") / F.lit(tolerance)).cast("long").alias("bucket")
    return table.groupBy("kind", bucket).agg(F.min("target_id").alias("first"), F.max("target_id").alias("last"), F.count("*").alias("n"))


def greatest_target(spark: SparkSession, kind: str) -> float:
    """The greatest mass of a target table, from the fixed values alone."""
    losses = max(m for _, m in P.LOSSES)
    if kind == "pair":
        return max(m for _, m in P.AMINOS) + losses + max(m for _, m in P.MODS)
    return max(m for _, m in P.AMINOS) + losses + max(abs(m) for _, m in P.SERIES) + max(m for _, m in P.MODS)


def combined_masses(spark: SparkSession, kind: str, k: int, quantum: float = 1e-6) -> DataFrame:
    """Distinct sums of ``k`` target masses, rounded to ``quantum``, and how many combinations give each.

    Combinations are added one target at a time and merged by mass each time, so the product is never built.
    """
    one = targets(spark, kind).select(F.rint(F.col("mass") / quantum).cast("long").alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    out = one
    for _ in range(k - 1):
        out = out.crossJoin(F.broadcast(one.select(F.col("q").alias("q2"), F.col("n").alias("n2")))).groupBy((F.col("q") + F.col("q2")).alias("q")).agg(F.sum(F.col("n") * F.col("n2")).alias("n"))
    return out.select((F.col("q") * quantum).alias("mass"), "n", F.lit(k).alias("k"))


def described(spark: SparkSession, hits: DataFrame, kind: str) -> DataFrame:
    """``hits`` (amino_id, left_loss_id, right_loss_id, mod_id) with the symbol and the mass of each; an id of -1 has '' and 0."""
    reflect = kind == "reflected"
    right = pair_losses(spark) if kind == "pair" else boundary_losses(spark, reflect)
    parts = [
        ("amino_id", aminos(spark).select(F.col("amino_id"), F.col("amino"), F.col("mass").alias("amino_mass"))),
        ("left_loss_id", pair_losses(spark).select(F.col("loss_id").alias("left_loss_id"), F.col("loss").alias("left_loss"), F.col("mass").alias("left_loss_mass"))),
        ("right_loss_id", right.select(F.col("loss_id").alias("right_loss_id"), F.col("loss").alias("right_loss"), F.col("mass").alias("right_loss_mass"))),
        ("mod_id", mods(spark, reflect).select("mod_id", "mod", F.col("mass").alias("mod_mass"))),
    ]
    for key, table in parts:
        hits = hits.join(F.broadcast(table), key, "left")
    return hits.fillna("", ["amino", "left_loss", "right_loss", "mod"]).fillna(0.0, ["amino_mass", "left_loss_mass", "right_loss_mass", "mod_mass"])


def series_losses(spark: SparkSession, series: list[str]) -> DataFrame:
    """The boundary losses of each of ``series``."""
    chosen = F.lit(False)
    for x in series:
        chosen = chosen | F.col("loss").startswith(x)
    return boundary_losses(spark).filter(chosen)
