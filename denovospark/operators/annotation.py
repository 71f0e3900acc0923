"""The annotation of one spectrum after another, in sorted streams.

Peaks are shuffled once to their spectrum. Masses, pairs, boundaries, pivots, symmetries and labels of the spectra of some batches are made at once within the task, and never leave it;
what does are the labelled peaks by their node, or the clusters, the symmetric nodes and the edges with the targets that they fit. Spectra of more than PEAKS peaks are left to joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.params import HYDROGEN, AnnotationParams
from . import streams
from .labels import NODE_TOLERANCE
from .symmetry import matched_runs
from .topology import SINK, SOURCE

#: Peaks of a spectrum up to which it is annotated within a task.
PEAKS = 128
#: Upper boundaries of a cluster are numbered from here on, each cluster from its own multiple.
UPPER = 1_000_000_000
#: What a row is: a labelled peak, a cluster, symmetric nodes, or an edge of a side.
NODE, CLUSTER, MATES, LOWER, HIGHER, PIVOT = range(6)
SIDES = ("lower", "upper", "pivot")
HIT = "struct<cost: double, amino_id: int, left_loss_id: int, right_loss_id: int, mod_id: int, target: double>"
_FEATURES = ("amino_id", "left_loss_id", "right_loss_id", "mod_id")
_HITS = pa.struct([("cost", pa.float64()), *((f, pa.int32()) for f in _FEATURES), ("target", pa.float64())])


@dataclass(frozen=True)
class Targets:
    """A target table by ascending mass, as arrays."""

    mass: np.ndarray
    factor: np.ndarray
    features: np.ndarray

    @staticmethod
    def of(table: DataFrame, *kinds: str) -> tuple[Targets, ...]:
        found = table.orderBy("mass").select("kind", "mass", "complexity", *_FEATURES).collect()  # about 1,000, whatever the data
        each = [[r[1:] for r in found if r[0] == kind] for kind in kinds]
        return tuple(Targets(np.array([r[0] for r in rows], float), np.array([1 + r[1] for r in rows], float), np.array([r[2:] for r in rows], np.int32).reshape(len(rows), len(_FEATURES))) for rows in each)

    def near(self, value: np.ndarray, tolerance: float) -> Hits:
        start = np.searchsorted(self.mass, value - tolerance)
        of, t = streams.spread(start, np.searchsorted(self.mass, value + tolerance, "right") - start)
        return Hits(of, np.abs(value[of] - self.mass[t]) * self.factor[t], self.features[t], self.mass[t])


@dataclass(frozen=True)
class Hits:
    """Targets within tolerance of values, by value: its place, cost, features and the target's mass."""

    of: np.ndarray
    cost: np.ndarray
    features: np.ndarray
    target: np.ndarray

    def ranges(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first hit of each of ``n`` values, and their number."""
        count = np.bincount(self.of, minlength=n)
        return np.cumsum(count) - count, count


def _starts(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each of ``n`` groups in rows by group, and their number."""
    count = np.bincount(group, minlength=n)
    return np.cumsum(count) - count, count


class _Spectra:
    """Peaks of some whole spectra (their number, id and m/z), and all that is found in them."""

    def __init__(self, own: np.ndarray, peak: np.ndarray, mz: np.ndarray, targets: tuple[Targets, Targets, Targets], params: AnnotationParams) -> None:
        self.own, self.peak, self.mz, self.n = own, peak, mz, int(own[-1]) + 1
        self.charges, self.tolerance = np.array(params.charges, np.int64), params.query_tolerance
        pair, boundary, reflected = targets
        # masses, by spectrum and mass
        mass, row, charge = self._decharged(np.arange(len(own)))
        row, charge, mass = (x[mass > 0] for x in (row, charge, mass))
        order = np.lexsort((peak[row], charge, mass, own[row]))
        self.row, self.charge, self.mass = row[order], charge[order], mass[order]
        self.of = own[self.row]
        self.start, self.count = _starts(self.of, self.n)
        self.idx = np.arange(len(order)) - self.start[self.of]
        self._find_pairs(pair)
        self.lower = boundary.near(self.mass, self.tolerance)
        self._find_pivots()
        self._find_clusters(params)
        self._find_upper(reflected)
        self._find_nodes()

    def _decharged(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        charge = np.tile(np.arange(1, len(self.charges) + 1), len(row))
        row = np.repeat(row, len(self.charges))
        by = self.charges[charge - 1]
        return by * self.mz[row] - HYDROGEN * (by - 1), row, charge

    def _find_pairs(self, targets: Targets) -> None:
        """Pairs of masses whose gap is near a target, and the hits of each."""
        m, none = self.mass, np.zeros(len(self.mass))
        least, most = (targets.mass[0] - self.tolerance, targets.mass[-1] + self.tolerance) if len(targets.mass) else (1.0, 0.0)
        self.ladder = streams.Ladder(self.of, m, none, float(np.max(m, initial=0.0)) + 2 * max(most, 0.0) + 1.0)
        first, count = self.ladder.span(self.of, none, m + least, m + most)
        found = []
        for block in streams.blocks(count):
            a, b = streams.spread(first[block], count[block])
            a = a + block.start
            gap = m[b] - m[a]
            kept = (gap >= least) & (gap <= most) & (a < b) & (self.peak[self.row[a]] != self.peak[self.row[b]])
            a, b, gap = a[kept], b[kept], gap[kept]
            hits = targets.near(gap, self.tolerance)
            each, at = np.unique(hits.of, return_inverse=True)
            found.append((a[each], b[each], at, hits))
        sizes = np.cumsum([0, *(len(x[0]) for x in found)])
        join = lambda x, kind=np.int64: np.concatenate([np.zeros((0, *x[0].shape[1:]), kind), *x]) if x else np.zeros(0, kind)
        self.left, self.right = join([x[0] for x in found]), join([x[1] for x in found])
        cost, features, target = (join([getattr(x[3], f) for x in found], kind) for f, kind in (("cost", float), ("features", np.int32), ("target", float)))
        self.pairs = Hits(join([x[2] + s for x, s in zip(found, sizes[:-1], strict=True)]), cost, features.reshape(-1, len(_FEATURES)), target)

    def _find_pivots(self) -> None:
        """Masses i < j < i2 < j2 in which (i, i2) is a pair and (j, j2) has its gap; the points that they lie about."""
        m, quads = self.mass, [np.zeros((4, 0), np.int64)]
        none = np.zeros(len(self.left))
        gap = m[self.right] - m[self.left]
        for block in streams.blocks(self.right - self.left - 1):
            p, j = streams.spread(self.left[block] + 1, (self.right - self.left - 1)[block])
            p = p + block.start
            start, n = self.ladder.span(self.of[j], none[p], m[j] + gap[p] - self.tolerance, m[j] + gap[p] + self.tolerance)
            for part in streams.blocks(n):
                q, j2 = streams.spread(start[part], n[part])
                q = q + part.start
                row, one = p[q], j[q]
                kept = (np.abs(gap[row] - (m[j2] - m[one])) < self.tolerance) & (self.right[row] < j2)
                row, one, j2 = row[kept], one[kept], j2[kept]
                quads.append(np.array([self.left[row], one, self.right[row], j2]))
        self.quads = np.concatenate(quads, axis=1)
        i, j, i2, j2 = self.quads
        point = np.rint((m[i] + m[j] + m[i2] + m[j2]) / 4 * 100.0) / 100.0
        order = np.lexsort((point, self.of[i]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(point[order]) != 0) | (np.diff(self.of[i][order]) != 0)
        self.point, self.point_of = point[order][new], self.of[i][order][new]
        self.quad_point = np.empty(len(order), np.int64)
        self.quad_point[order] = np.cumsum(new) - 1

    def _find_clusters(self, params: AnnotationParams) -> None:
        """Symmetries about all points, and the points that stay."""
        m, score, found = self.mass, np.zeros(len(self.point)), [np.zeros((3, 0), np.int64)]
        sizes = self.count[self.point_of]
        for block in streams.blocks(sizes):
            at, k = streams.spread(self.start[self.point_of[block]], sizes[block])
            at = at + block.start
            p, v = self.point[at], m[k]
            at, k, p, v = (x[v != p] for x in (at, k, p, v))
            right = v > p
            v = np.where(right, 2 * p - v, v)
            order = np.lexsort((np.where(right, 2 * len(m) - k, k), v, at))  # of equal values those below the point first, then those above from the greatest down
            at, k, v, right = at[order], k[order], v[order], right[order]
            one, two = matched_runs(at, v, right, params.symmetry_tolerance)
            score += np.bincount(at[one], 1 - np.abs(v[two] - v[one]), len(score))
            found.append(np.array([at[one], k[one], k[two]]))
        best = np.full(self.n, -np.inf)
        np.maximum.at(best, self.point_of, score)
        kept = score > best[self.point_of] * params.score_factor
        place = np.where(kept, np.cumsum(kept) - 1, -1)
        self.p, self.p_of, self.score = self.point[kept], self.point_of[kept], score[kept]
        self.p_start, self.p_count = _starts(self.p_of, self.n)
        self.cluster = np.arange(len(self.p)) - self.p_start[self.p_of]
        matched = np.concatenate(found, axis=1)
        matched[0] = place[matched[0]]
        self.matched = matched[:, matched[0] >= 0]
        self.kept_quads = self.quads[:, place[self.quad_point] >= 0]

    def _find_upper(self, targets: Targets) -> None:
        """Peaks reflected about the point of each cluster that are near a boundary."""
        first, count = _starts(self.own, self.n)
        c, row = streams.spread(first[self.p_of], count[self.p_of])
        mass, row, charge = self._decharged(row)
        c = np.repeat(c, len(self.charges))
        mass = 2 * self.p[c] - mass
        c, mass, row, charge = (x[mass > 0] for x in (c, mass, row, charge))
        order = np.lexsort((self.peak[row], charge, mass, c))
        self.up_c, self.up_mass, self.up_row, self.up_charge = c[order], mass[order], row[order], charge[order]
        start, _ = _starts(self.up_c, len(self.p))
        self.up_id = UPPER * (self.cluster[self.up_c] + 1) + np.arange(len(order)) - start[self.up_c]
        self.upper = targets.near(self.up_mass, self.tolerance)

    def _code(self, row: np.ndarray, charge: np.ndarray | int) -> np.ndarray:
        return row * (len(self.charges) + 1) + charge

    def _find_nodes(self) -> None:
        """Labels of each peak and charge: their number, the least cost and the node."""
        of = self._code(self.row, self.charge)
        single = self._code(self.row, 1)
        said = [(of[self.left[self.pairs.of]], self.pairs.cost), (of[self.right[self.pairs.of]], self.pairs.cost), (of[self.lower.of], self.lower.cost), (self._code(self.up_row, self.up_charge)[self.upper.of], self.upper.cost)]
        free = np.concatenate([single[self.kept_quads].reshape(-1), single[self.matched[1:]].reshape(-1)])
        code, cost = (np.concatenate(x) for x in zip(*said, (free, np.full(len(free), np.inf)), strict=True))
        size = len(self.own) * (len(self.charges) + 1)
        self.labels = np.bincount(code, minlength=size)
        self.cost = np.full(size, np.inf)
        np.minimum.at(self.cost, code, cost)
        self.labelled = np.flatnonzero(self.labels)
        row, charge = np.divmod(self.labelled, len(self.charges) + 1)
        place = np.trunc(self.mz[row] * charge / NODE_TOLERANCE)
        order = np.lexsort((place, self.own[row]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(place[order]) != 0) | (np.diff(self.own[row][order]) != 0)
        rank = np.cumsum(new) - 1
        first = np.full(self.n, len(order))
        np.minimum.at(first, self.own[row][order], rank)
        self.node = np.full(size, -1)
        self.node[self.labelled[order]] = rank - first[self.own[row][order]]

    def nodes(self) -> dict[str, np.ndarray]:
        row, charge = np.divmod(self.labelled, len(self.charges) + 1)
        return {"of": self.own[row], "a": self.peak[row], "b": charge, "c": self.node[self.labelled], "d": self.labels[self.labelled], "x": self.cost[self.labelled]}

    def clusters(self) -> dict[str, np.ndarray]:
        return {"of": self.p_of, "cluster_id": self.cluster, "x": self.p, "y": self.score}

    def mates(self) -> dict[str, np.ndarray]:
        c, low, high = self.matched
        low, high = (self.node[self._code(self.row[x], 1)] for x in (low, high))
        order = np.lexsort((high, low, c))
        c, low, high = (x[order] for x in (c, low, high))
        new = np.ones(len(c), bool)
        new[1:] = (np.diff(c) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)
        c, low, high = (x[new] for x in (c, low, high))
        return {"of": self.p_of[c], "cluster_id": self.cluster[c], "a": low, "b": high}

    def edges(self) -> tuple[dict[str, np.ndarray], pa.Array]:
        """Edges as ``topology.spectrum_edges`` makes them, with the targets that their weight fits."""
        node = self.node[self._code(self.row, self.charge)]
        tolerance = self.tolerance
        pair_first, pair_count = self.pairs.ranges(len(self.left))
        low_first, low_count = self.lower.ranges(len(self.mass))
        up_first, up_count = self.upper.ranges(len(self.up_mass))
        low_first, up_first = low_first + len(self.pairs.of), up_first + len(self.pairs.of) + len(self.lower.of)
        # a pair is an edge in each cluster of its spectrum
        own = self.of[self.left]
        k, c = streams.spread(self.p_start[own], self.p_count[own])
        one, two, p = self.left[k], self.right[k], self.p[c]
        side = np.where(self.mass[two] < p, LOWER, np.where((self.mass[one] > p) & (self.mass[two] < 2 * (p + tolerance)), HIGHER, PIVOT))
        src, dst = np.where(side == HIGHER, node[two], node[one]), np.where(side == HIGHER, node[one], node[two])
        parts = [(c, side, src, dst, self.idx[one] * (1 << 31) + self.idx[two], pair_first[k], pair_count[k])]
        cross = np.flatnonzero(side == PIVOT)
        fill = lambda x, like: np.full(len(like), x)
        for s, end in ((LOWER, one), (HIGHER, two)):
            parts.append((c[cross], fill(s, cross), node[end[cross]], fill(SINK, cross), fill(-1, cross), fill(0, cross), fill(0, cross)))
        at = np.flatnonzero(low_count)
        k, c = streams.spread(self.p_start[self.of[at]], self.p_count[self.of[at]])
        k = at[k]
        k, c = k[self.mass[k] < self.p[c]], c[self.mass[k] < self.p[c]]
        parts.append((c, fill(LOWER, k), fill(SOURCE, k), node[k], self.idx[k], low_first[k], low_count[k]))
        k = np.flatnonzero(up_count)
        p = self.p[self.up_c[k]]
        back = 2 * p - self.up_mass[k]
        k = k[(back > p) & (back < 2 * (p + tolerance))]
        parts.append((self.up_c[k], fill(HIGHER, k), fill(SOURCE, k), self.node[self._code(self.up_row[k], self.up_charge[k])], self.up_id[k], up_first[k], up_count[k]))
        c, side, src, dst, weight, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((weight, dst, src, side, c))  # of several the one of the greatest weight
        last = np.ones(len(order), bool)
        last[:-1] = np.any(np.diff(np.array([x[order] for x in (c, side, src, dst)]), axis=1) != 0, axis=0)
        c, side, src, dst, weight, first, count = (x[order][last] for x in (c, side, src, dst, weight, first, count))
        _, k = streams.spread(first, count)
        cost, features, target = (np.concatenate([getattr(h, f) for h in (self.pairs, self.lower, self.upper)])[k] for f in ("cost", "features", "target"))
        fields = [pa.array(cost), *(pa.array(np.ascontiguousarray(features[:, f])) for f in range(len(_FEATURES))), pa.array(target)]
        hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(_HITS)))
        return {"of": self.p_of[c], "kind": side, "cluster_id": self.cluster[c], "a": src, "b": dst, "c": weight}, hits


def large_spectra(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("spectrum").count().filter(F.col("count") > PEAKS).select("spectrum")


def annotated(peaks: DataFrame, targets: DataFrame, params: AnnotationParams, nodes: bool) -> DataFrame:
    """(spectrum, kind, cluster_id, a, b, c, d, x, y, hits) of spectra (spectrum, peak_id, mz) of some peaks each; a column that a kind doesn't use is null.

    With ``nodes`` the labelled peaks: NODE, a: peak_id, b: charge, c: node, d: number of labels, x: the least cost, infinite without any. Else CLUSTER, x: point, y: score; MATES, a and b: symmetric
    nodes; LOWER, HIGHER and PIVOT, a: src, b: dst, c: weight, hits: what the edge's weight fits.
    """
    known = Targets.of(targets, "pair", "boundary", "reflected")
    schema = StructType([peaks.schema["spectrum"]])
    schema = StructType(schema.fields + StructType.fromDDL(f"kind int, cluster_id int, a long, b long, c long, d long, x double, y double, hits array<{HIT}>").fields)
    kinds = dict(kind=pa.int32(), cluster_id=pa.int32(), a=pa.int64(), b=pa.int64(), c=pa.int64(), d=pa.int64(), x=pa.float64(), y=pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, own in streams.whole_segments(batches, ["spectrum"]):
            found = _Spectra(own, table.column("peak_id").to_numpy(), table.column("mz").to_numpy(), known, params)
            first = np.flatnonzero(np.diff(own, prepend=-1))

            def rows(of: np.ndarray, hits: pa.Array | None = None, **columns: np.ndarray | int) -> Iterator[pa.RecordBatch]:
                none = lambda kind: pa.nulls(len(of), kind)
                given = [pa.array(np.broadcast_to(columns[c], len(of)), kind) if c in columns else none(kind) for c, kind in kinds.items()]  # noqa: B023
                held = table.select(["spectrum"]).take(pa.array(first[of]))  # noqa: B023
                yield from pa.Table.from_arrays([*held.columns, *given, none(pa.list_(_HITS)) if hits is None else hits], names=schema.names).combine_chunks().to_batches()

            if nodes:
                yield from rows(**found.nodes(), kind=NODE)
                continue
            yield from rows(**found.clusters(), kind=CLUSTER)
            yield from rows(**found.mates(), kind=MATES)
            edges, hits = found.edges()
            yield from rows(**edges, hits=hits)

    whole = peaks.filter(streams.finite("mz")).select("spectrum", F.col("peak_id").cast("long").alias("peak_id"), "mz")
    return streams.in_segments(whole, ["spectrum"], ["peak_id"]).mapInArrow(run, schema)
