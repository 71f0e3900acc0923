"""Symmetry about a pivot: a greedy, order-dependent match of two descending lists, and the scores made of it.

A match never spans a gap over the tolerance, so both sides' values are sorted together and cut into runs at such gaps. Most runs are of two values, and
matched all at once; the greedy match sees the others. Groups of up to GROUP values are sorted in one shuffle and matched in batches of groups; a
spectrum's masses are reflected about its points within the task. Larger groups are never listed: their values lie in slices of mass,
each sorted by itself, the cuts between slices come from a slice's ends, and a run is what a task sees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import streams

#: Tolerances in a slice.
SLICE = 1000
#: Values of a group up to which it is matched as a whole.
GROUP = 200_000


def merge_match(left: list[float], right: list[float], tolerance: float, more: tuple[bool, bool] = (False, False)) -> list[tuple[int, int]]:
    """Indices of matches. Both lists descend; a value may match again the last matched one of the other side.

    The match ends with either list. ``more``: whether a list goes on, with values that are too far away to match.
    """
    out: list[tuple[int, int]] = []
    lists = [[*x, -math.inf] if m else x for x, m in zip((left, right), more, strict=True)]
    at, last = [0, 0], [math.inf, math.inf]
    near = lambda x, y: abs(x - y) <= tolerance
    while all(k < len(x) for k, x in zip(at, lists, strict=True)):
        now = [x[k] for k, x in zip(at, lists, strict=True)]
        if now[0] == now[1] == -math.inf:
            break
        # which sides take part with their current value: both, else one with the other's last
        if near(*now):
            takes = (True, True)
        elif near(last[0], now[1]):
            takes = (False, True)
        elif near(now[0], last[1]):
            takes = (True, False)
        else:
            at[int(now[0] < now[1])] += 1
            continue
        out.append(tuple(at[s] - (not takes[s]) for s in (0, 1)))
        for s in (0, 1):
            if takes[s]:
                last[s] = now[s]
                at[s] += 1
    return out


def with_runs(values: DataFrame, on: tuple[str, ...], tolerance: float) -> DataFrame:
    """``values`` (on, v) with the number ``run`` of the run, from above, of values without a gap over ``tolerance``."""
    reach = F.lit(_reach(tolerance))
    placed = values.withColumn("_slice", F.floor(F.col("v") / F.lit(SLICE * tolerance)))
    inner = W.partitionBy(*on, "_slice").orderBy(F.desc("v"))
    cut = F.coalesce(F.lag("v").over(inner) - F.col("v") > reach, F.lit(False)).cast("long")
    placed = placed.withColumn("_cut", cut).withColumn("_within", F.sum("_cut").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    slices = placed.groupBy(*on, "_slice").agg(F.max("v").alias("_top"), F.min("v").alias("_bottom"), F.sum("_cut").alias("_cuts"))
    outer = W.partitionBy(*on).orderBy(F.desc("_slice"))  # slices, not values
    edge = F.coalesce(F.lag("_bottom").over(outer) - F.col("_top") > reach, F.lit(False)).cast("long")
    slices = slices.withColumn("_edge", edge + F.coalesce(F.lag("_cuts").over(outer), F.lit(0)))
    slices = slices.select(*on, "_slice", F.sum("_edge").over(outer.rowsBetween(W.unboundedPreceding, 0)).alias("_start"))
    return placed.join(slices, [*on, "_slice"]).withColumn("run", F.col("_start") + F.col("_within")).drop("_slice", "_cut", "_within", "_start")


def run_lists(values: DataFrame, on: tuple[str, ...], tolerance: float) -> DataFrame:
    """The runs that hold values of both sides: (on, run, left, right, more_left, more_right), lists of (v, turn, i) that descend.

    ``values``: on, side (left or right), v, turn (the order of equal values, descending), i. more_*: whether the side has values below the run.
    """
    of = lambda s, c: F.when(F.col("side") == s, c)
    entry = F.struct("v", "turn", "i")
    # aggregated by run first, so that a group's least values are found among its runs
    held = with_runs(values, on, tolerance).groupBy(*on, "run").agg(
        *(F.sort_array(F.collect_list(of(s, entry)), asc=False).alias(s) for s in ("left", "right")), *(F.min(of(s, F.col("v"))).alias(f"least_{s}") for s in ("left", "right"))
    )
    whole = W.partitionBy(*on)
    more = {f"more_{s}": F.min(f"least_{s}").over(whole) < F.col(f"least_{s}") for s in ("left", "right")}
    return held.withColumns(more).filter((F.size("left") > 0) & (F.size("right") > 0)).drop("least_left", "least_right")


def _mapped(rows: DataFrame, on: tuple[str, ...], match: Callable[[list, list, tuple[bool, bool]], list[tuple]], columns: str) -> DataFrame:
    """``match`` over each run's lists; many runs a call, so that small ones cost no call each."""
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = zip(batch["left"], batch["right"], batch["more_left"], batch["more_right"], *(batch[c] for c in on), strict=True)
            out = [(*key, *m) for left, right, more_left, more_right, *key in lists for m in match(list(left), list(right), (more_left, more_right))]
            yield pd.DataFrame(out, columns=[*on, *names])

    return rows.drop("run").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in on) + ", " + columns)


def _values(rows: list[dict]) -> list[float]:
    return [x["v"] for x in rows]


def _reach(tolerance: float) -> float:
    return tolerance * (1 + 1e-6) + 1e-9  # differences are rounded


def matched_runs(group: np.ndarray, v: np.ndarray, right: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (left, right) of the greedy matches of many groups, in rows that ascend by value within each."""
    if not len(v):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.concatenate([[True], group[1:] != group[:-1]])
    cut = begins.copy()
    cut[1:] |= np.diff(v) > _reach(tolerance)
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(v))
    rights = np.concatenate([[0], np.cumsum(right)])
    n_right = rights[end] - rights[start]
    both = (n_right > 0) & (n_right < end - start)
    s = start[both & (end - start == 2)]
    s = s[np.abs(v[s] - v[s + 1]) <= tolerance]
    first = right[s]
    out = [(np.where(first, s + 1, s), np.where(first, s, s + 1))]
    larger = np.flatnonzero(both & (end - start > 2))
    of_group = np.flatnonzero(begins)[np.cumsum(begins)[start[larger]] - 1]
    before = rights[start[larger]] - rights[of_group]
    for a, b, more_left, more_right in zip(start[larger].tolist(), end[larger].tolist(), (start[larger] - of_group > before).tolist(), (before > 0).tolist(), strict=True):
        down = np.arange(b - 1, a - 1, -1)
        one, two = down[~right[down]], down[right[down]]
        found = merge_match(v[one].tolist(), v[two].tolist(), tolerance, (more_left, more_right))
        if found:
            i, j = np.array(found).T
            out.append((one[i], two[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _reflected(m: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For ascending masses and each point: (place of the point, place of the mass, value, right), masses below and reflections of those above, ascending by value."""
    n = len(m)
    low, high = np.searchsorted(m, points, "left")[:, None], np.searchsorted(m, points, "right")[:, None]
    k = np.arange(n)[None, :]
    at = np.where(k < low, k, n - 1 - (k - low))  # those above from the greatest down, so that they ascend when reflected
    used = k < low + n - high
    right = k >= low
    v = np.where(right, 2 * points[:, None] - m[at], m[at])
    v = np.where(used, v, np.inf)
    order = np.argsort(v, axis=1, kind="stable")
    take = lambda x: np.take_along_axis(x, order, 1)[take_used]
    take_used = np.arange(n)[None, :] < low + n - high
    return np.broadcast_to(np.arange(len(points))[:, None], take_used.shape)[take_used], take(at), take(v), take(np.broadcast_to(right, at.shape))


def _small(aug: DataFrame, on: tuple[str, ...], narrow: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to GROUP rows, and those of larger ones, if there are any. ``narrow``: what to count instead of ``aug``."""
    large = (aug if narrow is None else narrow).groupBy(*on).count().filter(F.col("count") > GROUP).select(*on)
    if large.isEmpty():
        return aug, None
    return aug.join(large, list(on), "left_anti"), aug.join(large, list(on), "left_semi")


def _at_points(aug: DataFrame, points: DataFrame, tolerance: float, on: tuple[str, ...], say: Callable, schema: StructType) -> DataFrame:
    """``say`` (key, points, place of the point, low index, high index, delta) over the symmetries of some points of a spectrum."""
    extra = [c for c in points.columns if c not in (*on, "point")]
    masses = aug.filter(streams.finite("mass")).select(*on, F.lit(0).alias("_kind"), F.col("mass").alias("_v"), F.col("aug_idx").cast("long").alias("_i"), *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in extra))
    places = points.filter(streams.finite("point")).select(*on, F.lit(1).alias("_kind"), F.col("point").alias("_v"), F.lit(None).cast("long").alias("_i"), *extra)
    keys = list(on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, segment in streams.whole_segments(batches, keys):
            kind, v = table.column("_kind").to_numpy(), table.column("_v").to_numpy()
            idx = table.column("_i").fill_null(-1).to_numpy()
            edges = np.append(np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])), len(v))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                middle = a + int(np.searchsorted(kind[a:b], 1))
                if middle == b:
                    continue
                m, i = v[a:middle], idx[a:middle]
                size = max(streams.BLOCK // max(len(m), 1), 1)
                for first in range(middle, b, size):
                    last = min(first + size, b)
                    point, at, value, right = _reflected(m, v[first:last])
                    one, two = matched_runs(point, value, right, tolerance)
                    out = say(table.slice(first, last - first), point[one], i[at[one]], i[at[two]], np.abs(value[two] - value[one]))
                    yield from out.combine_chunks().to_batches()

    return streams.in_segments(masses.unionByName(places), keys, ["_kind", "_v", "_i"]).mapInArrow(run, schema)


def symmetries(aug: DataFrame, clusters: DataFrame, tolerance: float, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """(on, point, low_idx, high_idx, delta) for each cluster (on, point): masses below the point and reflections of those above it that match."""
    small, large = _small(aug, on)
    points = clusters.select(*on, "point").distinct()
    schema = StructType([points.schema[c] for c in (*on, "point")]).add("low_idx", "integer").add("high_idx", "integer").add("delta", "double")

    def say(rows: pa.Table, point: np.ndarray, low: np.ndarray, high: np.ndarray, delta: np.ndarray) -> pa.Table:
        held = rows.select([*on, "_v"]).take(point)
        return pa.Table.from_arrays([*held.columns, pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(delta)], names=schema.names)

    found = _at_points(small, points, tolerance, on, say, schema)
    return found if large is None else found.unionByName(symmetries_by_runs(large, points, tolerance, on))


def symmetry_scores(aug: DataFrame, clusters: DataFrame, tolerance: float, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """``scored`` of the clusters' symmetries: what is summed up within the task is never written."""
    small, large = _small(aug, on)
    rest = [c for c in clusters.columns if c not in (*on, "point")]
    schema = StructType([clusters.schema[c] for c in (*on, "point", *rest)]).add("score", "double").add("n_symmetries", "long")

    def say(rows: pa.Table, point: np.ndarray, low: np.ndarray, high: np.ndarray, delta: np.ndarray) -> pa.Table:
        score = np.bincount(point, 1 - delta, len(rows)).astype(float)  # whole numbers without any match
        return pa.Table.from_arrays([*rows.select([*on, "_v", *rest]).columns, pa.array(score), pa.array(np.bincount(point, minlength=len(rows)))], names=schema.names)

    if large is None:
        return _at_points(aug, clusters, tolerance, on, say, schema)
    hot = large.select(*on).distinct()
    found = _at_points(small, clusters.join(hot, list(on), "left_anti"), tolerance, on, say, schema)
    points = clusters.join(hot, list(on), "left_semi")
    return found.unionByName(scored(symmetries_by_runs(large, points, tolerance, on), points, on).select(*schema.names))


def symmetries_by_runs(aug: DataFrame, clusters: DataFrame, tolerance: float, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """``symmetries`` of spectra of any size: each point's values are dealt by slices."""
    placed = aug.select(*on, F.col("aug_idx").cast("long").alias("i"), "mass").join(clusters.select(*on, "point").distinct(), list(on)).filter("mass <> point")
    below = F.col("mass") < F.col("point")
    values = placed.select(
        *on, "point", F.when(below, "left").otherwise("right").alias("side"), F.when(below, F.col("mass")).otherwise(2 * F.col("point") - F.col("mass")).alias("v"),
        F.when(below, F.col("i")).otherwise(-F.col("i")).alias("turn"), "i",
    )

    def match(left: list[dict], right: list[dict], more: tuple[bool, bool]) -> list[tuple]:
        found = merge_match(_values(left), _values(right), tolerance, more)
        return [(left[a]["i"], right[b]["i"], abs(right[b]["v"] - left[a]["v"])) for a, b in found]

    return _mapped(run_lists(values, (*on, "point"), tolerance), (*on, "point"), match, "low_idx int, high_idx int, delta double")


def scored(matched: DataFrame, clusters: DataFrame, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """Clusters with the sum of 1 - delta over their symmetries, 0 without any."""
    sums = matched.groupBy(*on, "point").agg(F.sum(1 - F.col("delta")).alias("score"), F.count("*").alias("n_symmetries"))
    return clusters.join(sums, [*on, "point"], "left").fillna(0, ["score", "n_symmetries"])


def screened(scores: DataFrame, factor: float, on: tuple[str, ...] = ("spectrum",)) -> DataFrame:
    """The clusters above ``factor`` of their spectrum's best score, numbered by place."""
    best = F.max("score").over(W.partitionBy(*on))
    kept = scores.withColumn("_best", best).filter(F.col("score") > F.col("_best") * factor).drop("_best")
    return kept.withColumn("cluster_id", F.row_number().over(W.partitionBy(*on).orderBy("point")) - 1)


def fuzzy_matches(left: list[float], right: list[float], tolerance: float) -> list[tuple[int, int]]:
    """One-to-one matches of two ascending lists, strictly within tolerance, greedy from the left."""
    out, j = [], 0
    for i, x in enumerate(left):
        while j < len(right) and right[j] <= x - tolerance:
            j += 1
        if j < len(right) and abs(right[j] - x) < tolerance:
            out.append((i, j))
            j += 1
    return out


def _sides(left: DataFrame, right: DataFrame, on: tuple[str, ...], value: str, idx: str | None, carried: tuple[str, ...] = ()) -> DataFrame:
    i = (F.col(idx) if idx else F.lit(0)).cast("long")
    held = [F.col(c).alias(f"_of_{k}") for k, c in enumerate(carried)]
    side = lambda df, name: df.select(*on, F.lit(name).alias("side"), F.col(value).cast("double").alias("v"), i.alias("turn"), i.alias("i"), *held).filter("v is not null")
    return side(left, "left").unionByName(side(right, "right"))


def list_matches(left: DataFrame, right: DataFrame, on: tuple[str, ...], value: str, idx: str, tolerance: float, carried: tuple[str, ...] = ()) -> DataFrame:
    """(on, idx, other_idx): the greedy match of both sides' values, from the greatest down; and of each column of both that is ``carried``, c and other_c, without a join."""
    values, large = _small(_sides(left, right, on, value, idx, carried), on, _sides(left, right, on, value, idx))
    schema = StructType([values.schema[c] for c in on]).add("idx", "long").add("other_idx", "long")
    places = [f"_of_{k}" for k in range(len(carried))]
    for prefix in ("", "other_"):
        for c, place in zip(carried, places, strict=True):
            schema = schema.add(f"{prefix}{c}", values.schema[place].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in streams.whole_segments(batches, list(on)):
            one, two = matched_runs(group, table.column("v").to_numpy(), table.column("right").to_numpy(zero_copy_only=False), tolerance)
            i = table.column("i")
            held = table.select(places)
            out = [*table.select(list(on)).take(one).columns, i.take(pa.array(one)), i.take(pa.array(two)), *held.take(one).columns, *held.take(two).columns]
            yield from pa.Table.from_arrays(out, names=schema.names).combine_chunks().to_batches()

    sided = values.filter(streams.finite("v")).select(*on, "v", (F.col("side") == "right").alias("right"), F.coalesce("i", F.lit(0).cast("long")).alias("i"), *places)
    found = streams.in_segments(sided, list(on), ["v", "i"]).mapInArrow(run, schema)
    if large is None:
        return found
    match = lambda a, b, more: [(a[i]["i"], b[j]["i"]) for i, j in merge_match(_values(a), _values(b), tolerance, more)]
    far = _mapped(run_lists(large.drop(*places), on, tolerance), on, match, "idx long, other_idx long")
    for side, i, prefix in (("left", "idx", ""), ("right", "other_idx", "other_")):
        rows = large.filter(F.col("side") == side).select(*on, F.col("i").alias(i), *(F.col(p).alias(f"{prefix}{c}") for p, c in zip(places, carried, strict=True)))
        far = far.join(rows.hint("merge"), [*on, i]) if carried else far
    return found.unionByName(far)


def fuzzy_join(left: DataFrame, right: DataFrame, tolerance: float, on: tuple[str, ...] = ("spectrum",), value: str = "mass") -> DataFrame:
    """(on, left, right): greedy one-to-one matches of the sorted values of both sides within each group."""
    def match(a: list[dict], b: list[dict], _: tuple[bool, bool]) -> list[tuple]:
        one, two = _values(a)[::-1], _values(b)[::-1]
        return [(one[i], two[j]) for i, j in fuzzy_matches(one, two, tolerance)]

    return _mapped(run_lists(_sides(left, right, on, value, None), on, tolerance), on, match, "left double, right double")
