"""Searches of masses: pairs, boundaries and overlap pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..functions.scalars import rounded
from . import streams
from .bandjoin import band_join, gap_join


def _hits(found: DataFrame, query: str) -> DataFrame:
    return found.withColumn("cost", F.abs(F.col(query) - F.col("target")) * (1 + F.col("complexity")))


def peak_pairs(aug: DataFrame, least: float, most: float, on: tuple[str, ...] = ("spectrum",), same_peak: bool = False) -> DataFrame:
    """(on, i, left_peak, left_charge, m1, j, right_peak, right_charge, m2, gap): masses whose gap lies in [least, most]. Pairs of one original peak are left out, unless ``same_peak``."""
    columns = ["aug_idx", "peak_id", "charge", "mass"]
    pairs = gap_join(aug.select(*on, *columns), list(on), "mass", least, most, ["i", "left_peak", "left_charge", "m1"], ["j", "right_peak", "right_charge", "m2"])
    pairs = pairs.filter(F.col("i") < F.col("j")).withColumn("gap", F.col("m2") - F.col("m1"))
    return pairs if same_peak else pairs.filter(F.col("left_peak") != F.col("right_peak"))


def find_pairs(aug: DataFrame, targets: DataFrame, tolerance: float, on: tuple[str, ...] = ("spectrum",), same_peak: bool = False, first_by: list[str] | None = None) -> DataFrame:
    """A row for each pair of masses and each target within tolerance of its gap, with cost = |gap - target| (1 + complexity).

    With ``first_by``, columns of whole numbers of the targets, ``first`` says of a row that it is its pair's first with these values, so that pairs can be counted without a shuffle of them.

    ``aug`` has ``on``, aug_idx, peak_id, charge, mass. The targets, a table of fixed size, go to all tasks. A spectrum is cut into segments as long as the longest gap; a
    segment's pairs begin in it and end there or in the next, whose masses it has, too. Only masses are shuffled.
    """
    named = [c for c in targets.columns if c != "mass"]
    rows = targets.orderBy("mass").select("mass", *named).collect()
    kinds = targets.select(*named).schema
    sizes = aug.select(*on, "aug_idx", "peak_id", "charge", "mass").schema
    left = {"i": "aug_idx", "left_peak": "peak_id", "left_charge": "charge", "m1": "mass"}
    right = {"j": "aug_idx", "right_peak": "peak_id", "right_charge": "charge", "m2": "mass"}
    schema = StructType([sizes[c] for c in on] + [StructField(n, sizes[c].dataType) for n, c in (left | right).items()])
    schema = schema.add("gap", "double").add("target", "double")
    for field in kinds:
        schema = schema.add(field.name, field.dataType)
    schema = schema.add("cost", "double")
    if first_by is not None:
        schema = schema.add("first", "boolean")
        by = np.unique([[r[c] for c in first_by] for r in rows], axis=0, return_inverse=True)[1].reshape(-1) if first_by and rows else np.zeros(len(rows), np.int64)
    if not rows:
        return aug.sparkSession.createDataFrame([], schema)
    mass = np.array([r["mass"] for r in rows], float)
    factor = np.array([1 + r["complexity"] for r in rows], float)
    said = pa.Table.from_pydict({f.name: pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in kinds})
    least, most = float(mass[0]) - tolerance, float(mass[-1]) + tolerance
    width = max(most, 1e-9)
    keys = [*on, "_segment"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, segment in streams.whole_segments(batches, keys):
            m, idx, peak, own = (table.column(c).to_numpy() for c in ("mass", "aug_idx", "peak_id", "_own"))
            base = table.column("_segment").to_numpy() * width
            first, count = streams.Ladder(segment, m, base, 4 * width).span(segment, base, m + least, m + most)
            count = np.where(own, count, 0)
            for block in streams.blocks(count):
                a, b = streams.spread(first[block], count[block])
                a = a + block.start
                gap = m[b] - m[a]
                kept = (gap >= least) & (gap <= most) & (idx[a] < idx[b])
                if not same_peak:
                    kept &= peak[a] != peak[b]
                a, b, gap = a[kept], b[kept], gap[kept]
                low, high = gap - tolerance, gap + tolerance
                start = np.searchsorted(mass, low)
                of, t = streams.spread(start, np.searchsorted(mass, high, "right") - start)
                if not len(of):
                    continue
                one, two, t_at = table.take(a[of]), table.take(b[of]), said.take(t)
                cost = np.abs(gap[of] - mass[t]) * factor[t]
                columns = [one.column(c) for c in (*on, *left.values())] + [two.column(c) for c in right.values()] + [pa.array(gap[of]), pa.array(mass[t]), *t_at.columns, pa.array(cost)]
                if first_by is not None:
                    first_of = np.zeros(len(of), bool)
                    first_of[np.unique(of * len(rows) + by[t], return_index=True)[1]] = True
                    columns.append(pa.array(first_of))
                yield from pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches()

    place = F.floor(F.col("mass") / F.lit(width))
    dealt = aug.filter(streams.finite("mass")).select(*on, "aug_idx", "peak_id", "charge", "mass", F.explode(F.array(F.struct(place.alias("s"), F.lit(True).alias("own")), F.struct((place - 1).alias("s"), F.lit(False).alias("own")))).alias("_s"))
    dealt = dealt.select(*on, "aug_idx", "peak_id", "charge", "mass", F.col("_s.s").alias("_segment"), F.col("_s.own").alias("_own"))
    return streams.in_segments(dealt, keys, ["mass", "aug_idx"]).mapInArrow(search, schema)


def find_boundaries(aug: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """A row for each mass and each target within tolerance of it."""
    return _hits(band_join(aug, targets.withColumnRenamed("mass", "target"), "mass", "target", tolerance, right_rows=targets.count()), "mass")


def overlap_pivots(aug: DataFrame, pairs: DataFrame, tolerance: float, most: float | None = None, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """Quadruples i < j < i2 < j2 in which (i, i2) is a found pair and (j, j2) has the same gap, strictly within tolerance.

    ``most`` bounds the gaps: the greatest target and its tolerance; without it the pairs are searched for the greatest. Two overlapping pairs with one gap are reflections of each other about the mean of the four masses, the pivot.
    A spectrum is cut into segments as long as the greatest gap; a pair lies in the segment of its first mass, which also has the masses of the next two. Masses and pairs are shuffled, gaps aren't.
    """
    if most is None:
        most = pairs.agg(F.max("gap")).first()[0] or 0.0
    width = max(most + 2 * tolerance, 1e-9)
    keys, limit = [*on, "_segment"], most + tolerance
    none = F.lit(None).cast("double")
    place = lambda c: F.floor(F.col(c) / F.lit(width))
    masses = aug.filter(streams.finite("mass")).select(*on, F.explode(F.array(*(place("mass") - k for k in range(3)))).alias("_segment"), F.col("mass").alias("m1"), none.alias("m2"), F.col("aug_idx").cast("long").alias("i"), F.lit(-1).cast("long").alias("i2"))
    found = pairs.filter(F.col("gap") <= most + 2 * tolerance).select(*on, place("m1").alias("_segment"), "m1", "m2", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("i2"))
    sizes, idx = aug.select(*on, "aug_idx").schema, aug.schema["aug_idx"].dataType
    schema = StructType([sizes[c] for c in on] + [StructField(c, idx) for c in ("i", "j", "i2", "j2")]).add("pivot", "double")
    kind = to_arrow_type(idx)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, segment in streams.whole_segments(batches, keys):
            m1, m2, i, i2 = (table.column(c).to_numpy() for c in ("m1", "m2", "i", "i2"))
            base = table.column("_segment").to_numpy() * width
            at = np.flatnonzero(i2 < 0)  # masses
            pair = np.flatnonzero(i2 >= 0)
            if len(pair):  # a pair has a row for each of its targets, one after another
                same = (np.diff(segment[pair]) == 0) & (np.diff(i[pair]) == 0) & (np.diff(i2[pair]) == 0)
                pair = pair[np.concatenate([[True], ~same])]
            if not len(pair) or not len(at):
                continue
            m, idx_of = m1[at], i[at]
            ladder = streams.Ladder(segment[at], m, base[at], 5 * width)
            gap = m2[pair] - m1[pair]
            first, count = ladder.span(segment[pair], base[pair], m1[pair], m2[pair])
            for block in streams.blocks(count):
                p, j = streams.spread(first[block], count[block])
                p = p + block.start
                inside = (i[pair[p]] < idx_of[j]) & (idx_of[j] < i2[pair[p]])
                p, j = p[inside], j[inside]
                start, n = ladder.span(segment[pair[p]], base[pair[p]], m[j] + gap[p] - tolerance, m[j] + gap[p] + tolerance)
                for part in streams.blocks(n):
                    q, j2 = streams.spread(start[part], n[part])
                    q = q + part.start
                    row, one = p[q], j[q]
                    other = m[j2] - m[one]
                    kept = (np.abs(gap[row] - other) < tolerance) & (other >= 0) & (other <= limit) & (i2[pair[row]] < idx_of[j2])
                    row, one, j2 = row[kept], one[kept], j2[kept]
                    if not len(row):
                        continue
                    r = pair[row]
                    pivot = (m1[r] + m[one] + m2[r] + m[j2]) / 4
                    held = table.select(list(on)).take(r)
                    columns = [*held.columns, *(pa.array(x).cast(kind) for x in (i[r], idx_of[one], i2[r], idx_of[j2])), pa.array(pivot)]
                    yield from pa.Table.from_arrays(columns, names=schema.names).combine_chunks().to_batches()

    return streams.in_segments(masses.unionByName(found), keys, ["m1", "i", "i2"]).mapInArrow(search, schema)


def clustered(pivots: DataFrame, on: tuple[str, ...] = ("spectrum",), digits: int = 2) -> DataFrame:
    """(on, point, n): pivots by their rounded place."""
    return pivots.groupBy(*on, rounded(F.col("pivot"), digits).alias("point")).agg(F.count("*").alias("n"))


def virtual_pivots(midpoints: DataFrame, bin_width: float, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """Centres of the histogram bins whose count is above the three-quarter place of the distinct counts.

    ``midpoints`` has ``on`` and point. A group whose range is narrower than a bin has none.
    """
    ends = midpoints.groupBy(*on).agg(F.min("point").alias("low"), F.max("point").alias("high"))
    ends = ends.withColumn("bins", F.floor((F.col("high") - F.col("low")) / F.lit(bin_width)).cast("int")).filter("bins > 0")
    width = (F.col("high") - F.col("low")) / F.col("bins")
    binned = midpoints.join(ends, list(on)).withColumn("bin", F.least(F.floor((F.col("point") - F.col("low")) / width).cast("int"), F.col("bins") - 1))
    counts = binned.groupBy(*on, "bin", "low", "high", "bins").agg(F.count("*").alias("n"))
    # a bin without points counts 0, and is one of the distinct counts
    levels = counts.groupBy(*on).agg(F.collect_set("n").alias("s"), F.count("*").alias("full"), F.first("bins").alias("b"))
    levels = levels.withColumn("s", F.array_sort(F.when(F.col("full") < F.col("b"), F.array_append("s", F.lit(0).cast("long"))).otherwise(F.col("s"))))
    levels = levels.select(*on, F.get("s", F.floor(F.size("s") * 0.75).cast("int")).alias("level"))
    return counts.join(levels, list(on)).filter("n > level").select(*on, (F.col("low") + (F.col("bin") + 0.5) * width).alias("centre"), "n")
