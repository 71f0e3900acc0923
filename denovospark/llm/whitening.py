"""Operator 11: embedding whitening by matrix-free block subspace iteration.

Entries become whole numbers x = floor(64 c) + 1,000,000. The fit list holds each distinct vector once; a table in the shared
folder keeps it in packed blocks of rows. The covariance V of the fit list (centred, divisor n) is never formed: a Spark pass
over the blocks computes V Q for a thin Q, as the sum of Xᵀ(XQ) over the tasks' centred rows, and only its d x block entries come to
the driver. An iteration holds the block U of Ritz vectors, asks one pass for V R, where R spans U's residuals orthogonal to
what is known, and takes the best block of span[U, R, P] (QR and Rayleigh-Ritz; P is where the last step moved U).
Where all of the first k residuals ‖V u - e u‖ seem small, a fresh pass with U alone certifies them.

The driver holds some d x block matrices, a task one block of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pack, released, unpack

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on aren't whole numbers of a double any more, and count as not finite.
GREATEST = 2.0**52
#: Rows of a block.
BLOCK_ROWS = 8192


def whole(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that are whitened, and their floor(64 c): vectors of ``d`` entries that are all finite."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == d)
    if d == 0 or not len(rows):
        return rows[:0], np.zeros((0, d), np.int64)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
    good = (np.abs(scaled) < GREATEST).all(axis=1)  # false for NaN, too
    return rows[good], scaled[good].astype(np.int64)


def _width(most: np.ndarray) -> np.ndarray:
    """Bytes of an entry, by the greatest absolute one."""
    return np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))


def _keys(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Each vector as bytes, as narrow as its greatest entry allows, so that equal vectors have equal keys."""
    for batch in batches:
        _, x = whole(batch.column(0), d)
        widths = _width(np.abs(x).max(axis=1, initial=0))
        for w in np.unique(widths):
            part = np.ascontiguousarray(x[widths == w].astype(f"<i{w}"))
            offsets = np.arange(0, (len(part) + 1) * d * w, d * w, dtype=np.int64)
            keys = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(part)])
            yield pa.RecordBatch.from_arrays([keys.cast(pa.binary())], names=["key"])


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Keys of one width as packed blocks, with their sums."""
    def block(x: np.ndarray) -> pa.RecordBatch:
        sums = pa.array([x.sum(axis=0, dtype=np.int64).tolist()], pa.list_(pa.int64()))
        columns = [pa.array([len(x)], pa.int64()), pa.array([x.dtype.itemsize], pa.int32()), sums, pa.array([pack(x)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["rows", "width", "sums", "data"])

    held: dict[int, list[bytes]] = {2: [], 4: [], 8: []}
    matrix = lambda w: np.frombuffer(b"".join(held[w]), f"<i{w}").reshape(-1, d)
    for batch in batches:
        for key in batch.column(0).to_pylist():
            w = len(key) // d
            held[w].append(key)
            if len(held[w]) == BLOCK_ROWS:
                yield block(matrix(w))
                held[w] = []
    for w, keys in held.items():
        if keys:
            yield block(matrix(w))


@dataclass(frozen=True)
class Centre:
    """The mean S / n of floor(64 c), as whole numbers and rests in [0, 1): differences from it are exact but for one rounding."""

    n: int
    whole: np.ndarray
    rest: np.ndarray  # S - n * whole

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - S)^2 by row: in whole numbers of any length where those of 64 bits could overflow."""
        apart = x - self.whole
        greatest = int(np.abs(apart).max(initial=0)) * self.n + self.n
        kind = pa.decimal128(38, 0)
        if x.shape[1] * greatest * greatest < 1 << 63:
            by = apart * self.n - self.rest
            return pa.array((by * by).sum(axis=1)).cast(kind)
        from decimal import Decimal

        by = apart.astype(object) * self.n - self.rest.astype(object)
        return pa.array([Decimal(v) for v in (by * by).sum(axis=1)], kind)


def _summed(blocks: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``part`` (blocks x d to a matrix of fixed shape): summed in the tasks, then by matrix row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for w, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one = part(unpack(data, f"<i{w}").reshape(-1, d).astype(np.int64))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    width = part(np.zeros((0, d), np.int64)).shape[1]
    sums = blocks.select("width", "data").mapInArrow(lambda b: released(run(b)), "i int, v array<double>")
    rows = sums.groupBy("i").agg(*(F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width))).orderBy("i").collect()
    return np.array([r[1:] for r in rows], np.float64)


def covariance_times(blocks: DataFrame, centre: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q, and the trace of V: one pass."""
    d, b = q.shape

    def part(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        out = np.zeros((d, b + 1))
        out[:, :b] = c.T @ (c @ q)
        out[:, b] = (c * c).sum(axis=0)
        return out

    total = _summed(blocks, d, part) / centre.n
    return total[:, :b], float(total[:, b].sum())


def beside(basis: np.ndarray, block: np.ndarray, floor: float) -> np.ndarray:
    """An orthonormal basis of ``block`` without what ``basis`` spans; columns shorter than ``floor`` are dropped."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > floor] / lengths[lengths > floor]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8]
    return block


@dataclass(frozen=True)
class Components:
    vectors: np.ndarray  # d x k
    values: np.ndarray
    trace: float
    passes: int
    residual: float  # the greatest of the certified ones, relative to the first eigenvalue


def leading(times: Callable[[np.ndarray], tuple[np.ndarray, float]], d: int, k: int, block: int, tolerance: float = 1e-12, most: int = 500, seed: int = 11) -> Components:
    """The ``k`` leading eigenpairs of a positive matrix that is known by its products ``times`` alone.

    Ends when a fresh product shows every residual under ``tolerance`` of the first eigenvalue, or under 1e-9 of it and no
    longer falling (rounding). After ``most`` products without that RuntimeError is raised. Eigenvalues that are zero but for rounding are left out.
    """
    b = min(d, max(block, k))
    u = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))[0]
    vu, trace = times(u)
    p = vp = np.zeros((d, 0))
    passes, before = 1, np.inf
    fresh = True  # whether vu comes from a pass, not from combinations
    while True:
        values, turn = np.linalg.eigh((u.T @ vu + vu.T @ u) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        u, vu = u @ turn, vu @ turn
        scale = max(values[0], 0.0)
        lengths = np.linalg.norm(vu - u * values, axis=0)
        worst = lengths[:k].max() / scale if scale > 0 else 0.0
        settled = worst <= tolerance or (worst <= 1e-9 and worst > before / 2)
        if settled and fresh:
            break
        if passes >= most:
            raise RuntimeError(f"residuals of {worst:.1e} after {passes} passes")
        if settled:
            u = np.linalg.qr(u)[0]
            vu, _ = times(u)
            passes, fresh = passes + 1, True
            continue
        before = worst
        known = np.hstack([u, p])
        r = beside(known, vu - u * values, 1e-15 * scale)
        if r.shape[1]:
            vr, _ = times(r)
            passes += 1
        else:  # nothing is left besides what is known
            vr = r
        space, image = np.hstack([known, r]), np.hstack([vu, vp, vr])
        _, best = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        best = best[:, ::-1][:, :b]
        new, vnew = space @ best, image @ best
        # where the step moved the block, orthogonal to the block itself
        step = best.copy()
        step[:b] = 0
        step = step - best @ (best.T @ step)
        moved, s, _ = np.linalg.svd(step, full_matrices=False)
        moved = moved[:, s > 1e-8]
        u, vu, p, vp, fresh = new, vnew, space @ moved, image @ moved, False
    some = values[:k] > 1e-12 * max(scale, 1e-300) * d
    return Components(u[:, :k][:, some], values[:k][some], trace, passes, float(worst))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, block: int | None = None) -> DataFrame:
    """Whitened vectors: (``id_col``, n, deviation decimal(38,0), whitened array, explained array, identity_error), a row for each vector.

    A vector is left out if it is null, holds a null or an entry that isn't finite (or beyond 2^46), or has another number of entries than most
    (on ties: the greatest number). Repeated rows stay, and count once in the fit. Null and repeated ids are passed through. There are
    fewer than ``k`` components where the dimension or the rank is lower; a fit list of one vector has none, and then the arrays are empty and
    identity_error is 0. An empty table gives an empty result. Other columns are not read. ``block``: columns of an
    iteration, 2 ``k`` unless given; d x 3 block numbers are held.
    """
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = source.schema["id"].dataType.simpleString()
    dims = source.filter("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = dims["d"] if dims else 0
    schema = f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    keys = source.select("vector").mapInArrow(lambda b: released(_keys(b, d)), "key binary").distinct()
    blocks = materialize(keys.mapInArrow(lambda b: released(_blocks(b, d)), "rows long, width int, sums array<long>, data binary"), "whiten-blocks", "none")
    n = blocks.agg(F.sum("rows")).first()[0] or 0
    if n == 0:
        discard(blocks)
        return source.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sums = {r["i"]: r["s"] for r in blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()}
    centre = Centre.of(n, [sums[i] for i in range(d)])
    found = leading(lambda q: covariance_times(blocks, centre, q), d, min(k, d), block or 2 * k)
    onto = found.vectors / np.sqrt(found.values)
    share = (found.values / found.trace if len(found.values) else found.values).tolist()

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ onto
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = 0.0
    if share:
        of = _summed(blocks, d, moments) / n
        error = float(np.abs(of[:-1] - np.outer(of[-1], of[-1]) - np.eye(len(share))).max())
    discard(blocks)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column(1), d)
            m = len(rows)
            w = centre.centred(x) @ onto
            offsets = pa.array(np.arange(0, (m + 1) * len(share), len(share)) if share else np.zeros(m + 1), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))
            same = pa.array([share] * m, pa.list_(pa.float64()))
            columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(m, n)), centre.deviation(x), lists, same, pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(lambda b: released(project(b)), schema).withColumnRenamed("id", id_col)
