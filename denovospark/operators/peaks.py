"""Peak tables: simulated ions, decharging, reflection, masks, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.scalars import decharged, in_alphabet


def peptides(texts: DataFrame, text_col: str = "text", least: int = 7, most: int = 50) -> DataFrame:
    """Distinct words of the texts that spell a peptide; the word is its spectrum's key."""
    words = texts.select(F.explode(F.split(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    cleaned = words.select(F.translate(F.upper("w"), "'.", "").alias("peptide"))
    return cleaned.filter(F.length("peptide").between(least, most) & in_alphabet(F.col("peptide"))).distinct()


def residue_masses(peptide: Column) -> Column:
    """Array of residue masses in whole nano-daltons, which add up exactly in any order."""
    table = F.create_map(*(F.lit(x) for s, m in P.AMINOS for x in (s, round(m * 1e9))))
    return F.transform(F.filter(F.split(peptide, ""), lambda c: c != ""), lambda c: F.element_at(table, c))


def ions(peptide_table: DataFrame, max_charge: int = 1) -> DataFrame:
    """b and y ions: (peptide, series, position, charge, mz). One projection: no join, no shuffle."""
    mass = F.lit(0).cast("long")
    rows = peptide_table.select("peptide", residue_masses(F.col("peptide")).alias("m")).filter(F.size("m") > 1)
    rows = rows.select("peptide", "m", F.explode(F.sequence(F.lit(1), F.size("m") - 1)).alias("position"))
    total = lambda x: F.aggregate(x, mass, lambda s, v: s + v)
    b, y = total(F.slice("m", F.lit(1), F.col("position"))), total(F.slice("m", F.size("m") - F.col("position") + 1, F.col("position"))) + P.WATER_N
    series = rows.select("peptide", "position", F.explode(F.create_map(F.lit("b"), b, F.lit("y"), y)).alias("series", "nano"))
    charged = series.withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(max_charge))))
    return charged.select("peptide", "series", "position", "charge", ((F.col("nano") + F.col("charge").cast("long") * P.PROTON_N) / F.lit(1e9) / F.col("charge")).alias("mz"))


def generated(peptide_table: DataFrame, params: P.IonParams = P.SIMPLE) -> DataFrame:
    """Ions as a spectrum generator makes them: (peptide, series, position, loss, charge, mz); precursors are series p at the last position.

    A fragment loses what one of its residues can lose, a precursor any loss. One projection: no join, no shuffle.
    """
    zero = F.lit(0).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda s, v: s + v)
    rows = peptide_table.select("peptide", residue_masses(F.col("peptide")).alias("m")).filter(F.size("m") > 1)
    n = F.size("m")
    rows = rows.select("peptide", "m", F.explode(F.sequence(F.lit(1), n)).alias("position"))
    kind = lambda s, nano, part, when: F.when(when, F.struct(F.lit(s).alias("series"), nano.alias("nano"), part.alias("part")))
    at = F.col("position")
    inner, none = at < n, F.lit(False)
    start = F.substring("peptide", F.lit(1), at)
    end = F.substring("peptide", n - at + 1, at)
    kinds = [
        kind("b", total(F.slice("m", F.lit(1), at)), start, inner if "b" in params.series else none),
        kind("y", total(F.slice("m", n - at + 1, at)) + P.WATER_N, end, inner if "y" in params.series else none),
        kind("p", total("m") + P.WATER_N, F.lit("".join(P.LOSES.values())), at == n if params.precursors else none),
    ]
    whole = rows.select("peptide", "position", F.explode(F.array_compact(F.array(*kinds))).alias("i")).select("peptide", "position", "i.series", "i.nano", "i.part")
    lost = [F.struct(F.lit("").alias("loss"), zero.alias("less"))]
    if params.losses:
        lost += [F.when(F.col("part").rlike(f"[{r}]"), F.struct(F.lit(x).alias("loss"), F.lit(P.NEUTRAL_N[x]).cast("long").alias("less"))) for x, r in P.LOSES.items()]
    whole = whole.withColumn("l", F.explode(F.array_compact(F.array(*lost)))).withColumn("charge", F.explode(F.sequence(F.lit(1), F.lit(params.max_charge))))
    mz = (F.col("nano") - F.col("l.less") + F.col("charge").cast("long") * P.PROTON_N) / F.lit(1e9) / F.col("charge")
    return whole.select("peptide", "series", "position", "l.loss", "charge", mz.alias("mz"))


def alignments(paths: DataFrame) -> DataFrame:
    """(peptide, b_path, y_path, lower, upper): islands of both series (peptide, series, path, position) that spell the same residues.

    An island of y, read backwards, has to have the complements of an island of b. lower is the one whose positions are all less, else y.
    """
    held = paths.groupBy("peptide", "series", "path").agg(F.sort_array(F.collect_list("position")).alias("at"))  # a peptide's positions
    one = held.filter("series = 'b'").select("peptide", F.col("path").alias("b_path"), F.col("at").alias("b"))
    two = held.filter("series = 'y'").select("peptide", F.col("path").alias("y_path"), F.reverse("at").alias("y"))
    same = F.transform("y", lambda p: F.length("peptide") - p) == F.col("b")
    first = F.forall(F.zip_with("b", "y", lambda x, y: x < y), lambda x: x)
    return one.join(two, "peptide").filter(same).select("peptide", "b_path", "y_path", F.when(first, F.col("b")).otherwise(F.col("y")).alias("lower"), F.when(first, F.col("y")).otherwise(F.col("b")).alias("upper"))


def ion_names(table: DataFrame) -> DataFrame:
    return table.withColumn("ion", F.concat("series", "position", F.repeat(F.lit("+"), F.col("charge"))))


def true_pivots(ion_table: DataFrame) -> DataFrame:
    """The mean of the first two b and the last two y ions of charge 1."""
    length = F.length("peptide")
    first = (F.col("series") == "b") & (F.col("position") <= 2)
    last = (F.col("series") == "y") & (F.col("position") >= length - 2)
    return ion_table.filter((F.col("charge") == 1) & (first | last)).groupBy("peptide").agg(F.avg("mz").alias("pivot"))


def event_peaks(events: DataFrame) -> DataFrame:
    """A noisy spectrum for each user: value is m/z, props.k the intensity, 1 where it is missing."""
    return events.select(F.col("user_id").alias("spectrum"), F.col("event_id").alias("peak_id"), F.col("value").alias("mz"), F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(1.0)).alias("intensity"))


def augment(peaks: DataFrame, charges: tuple[int, ...] = (1, 2, 3), pivot: str | None = None, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """Each peak once for each charge with the charge removed, reflected about column ``pivot`` if given, positive ones kept.

    The charge is the place among ``charges``. ``aug_idx`` ranks a spectrum's masses from 0, ties by charge and peak.
    """
    options = F.array(*(F.struct(F.lit(i + 1).alias("charge"), F.lit(c).alias("by")) for i, c in enumerate(charges)))
    spread = peaks.withColumn("_o", F.explode(options)).withColumn("mass", decharged(F.col("mz"), F.col("_o.by"))).withColumn("charge", F.col("_o.charge")).drop("_o")
    if pivot:
        spread = spread.withColumn("mass", 2 * F.col(pivot) - F.col("mass"))
    order = W.partitionBy(*on).orderBy("mass", "charge", "peak_id")
    return spread.filter("mass > 0").withColumn("aug_idx", F.row_number().over(order) - 1)


def masked(peaks: DataFrame, series: str | None = None, charge: int | None = None) -> DataFrame:
    keep = F.lit(True)
    if series is not None:
        keep = keep & (F.col("series") == series)
    if charge is not None:
        keep = keep & (F.col("charge") == charge)
    return peaks.filter(keep)


def truncated(peaks: DataFrame, depth: int, series: str, charge: int, initial: bool = False, terminal: bool = False) -> DataFrame:
    """Without the ions of a series and charge that lie within ``depth`` of the asked ends (both, if neither is)."""
    both = initial == terminal
    inside = F.lit(True)
    if both or initial:
        inside = inside & (F.col("position") > depth)
    if both or terminal:
        inside = inside & (F.length("peptide") - depth > F.col("position"))
    return peaks.filter(~((F.col("series") == series) & (F.col("charge") == charge)) | inside)


def occluded(peaks: DataFrame, positions: list[int], series: str, charge: int) -> DataFrame:
    return peaks.filter(~((F.col("series") == series) & (F.col("charge") == charge) & F.col("position").isin(positions)))


def inserted(peaks: DataFrame, noise: DataFrame) -> DataFrame:
    """``noise`` (peptide, mz) added as peaks of series ., position 0 and charge 0."""
    return peaks.unionByName(noise.select("peptide", F.lit(".").alias("series"), F.lit(0).alias("position"), F.lit(0).alias("charge"), "mz"))


def noise(peaks: DataFrame, per_peak: float, seed: int, padding: float = 200.0) -> DataFrame:
    """Uniform peaks between a spectrum's extremes, widened by ``padding``: floor(``per_peak`` x its peaks) of them."""
    ends = peaks.groupBy("peptide").agg(F.greatest(F.min("mz") - padding, F.lit(0.0)).alias("low"), (F.max("mz") + padding).alias("high"), F.floor(F.count("*") * per_peak).cast("int").alias("n")).filter("n > 0")
    each = ends.select("peptide", "low", "high", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("peptide", (F.col("low") + F.rand(seed) * (F.col("high") - F.col("low"))).alias("mz"))


def series_paths(ion_table: DataFrame, pivots: DataFrame) -> DataFrame:
    """Islands of consecutive positions within a series, also broken where the pivot lies between two neighbours."""
    order = W.partitionBy("peptide", "series", "charge").orderBy("position")
    joined = ion_table.join(pivots, "peptide")
    gap = (F.col("position") != F.lag("position").over(order) + 1) | ((F.lag("mz").over(order) < F.col("pivot")) & (F.col("pivot") < F.col("mz")))
    return joined.withColumn("path", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def bounds(ion_table: DataFrame) -> DataFrame:
    """The rows at the least and the greatest position of each series, ties included, as lower and upper."""
    series = W.partitionBy("peptide", "series", "charge")
    ends = ion_table.withColumn("_low", F.min("position").over(series)).withColumn("_high", F.max("position").over(series))
    side = F.array_compact(F.array(F.when(F.col("position") == F.col("_low"), "lower"), F.when(F.col("position") == F.col("_high"), "upper")))
    return ends.withColumn("side", F.explode(side)).drop("_low", "_high")


def consecutive(ion_table: DataFrame, k: int = 1) -> DataFrame:
    """Pairs of ions of one series and charge, ``k`` positions apart: (peptide, series, charge, left, right, gap)."""
    one = ion_table.select("peptide", "series", "charge", F.col("position").alias("left"), F.col("mz").alias("m1"))
    two = ion_table.select("peptide", "series", "charge", F.col("position").alias("right"), F.col("mz").alias("m2"), (F.col("position") - k).alias("left"))
    return one.join(two, ["peptide", "series", "charge", "left"]).select("peptide", "series", "charge", "left", "right", (F.col("m2") - F.col("m1")).alias("gap"))
