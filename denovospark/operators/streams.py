"""Work on the masses of one segment after another, as sorted streams.

Spark deals the rows to segments (a spectrum, or a stretch of its masses), shuffles them once and sorts them within each partition; a task sees its rows
in order, and holds the segments of some batches at a time. What is expanded, the pairs of masses of a segment, is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidates that are looked at at once.
BLOCK = 1 << 20
#: More than any rounding of sums of masses; exact conditions follow.
SLACK = 1e-6


def finite(c: str) -> Column:
    """Not null, not NaN and not infinite: nothing else is within a tolerance of anything."""
    return F.abs(F.col(c)) < F.lit(float("inf"))


def in_segments(rows: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """``rows`` with each segment (``on``, without nulls) in one partition, in ``order``.

    They are dealt by a hash of ``on``, not by ``on``: Spark leaves out a shuffle of a union whose sides are dealt by the same columns already, and then merges each side's partitions by
    itself, so that a segment's rows lie apart.
    """
    kept = rows.filter(" and ".join(f"`{c}` is not null" for c in on))
    return kept.repartition(F.xxhash64(*on)).sortWithinPartitions(*on, *order)


def _differs(table: pa.Table, on: list[str]) -> np.ndarray:
    """Whether each row but the first is in another segment than the one before."""
    out = np.zeros(max(len(table) - 1, 0), bool)
    for c in on:
        x = table.column(c)
        out |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return out


def whole_segments(batches: Iterator[pa.RecordBatch], on: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole segments with the number, from 0, of each row's segment."""
    def numbered(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.combine_chunks()
        return table, np.concatenate([[0], np.cumsum(_differs(table, on))])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seam = pa.Table.from_batches([*(b.slice(b.num_rows - 1) for b in held[-1:]), batch])
        at = np.flatnonzero(_differs(seam, on))
        if not len(at):
            held.append(batch)  # goes on with the segment that is held
            continue
        last = int(at[-1]) + 1 - (1 if held else 0)
        done = [*held, *([batch.slice(0, last)] if last else [])]
        yield numbered(pa.Table.from_batches(done))
        held = [batch.slice(last)]
    if held:
        yield numbered(pa.Table.from_batches(held))


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``count``[k] numbers from ``first``[k] on: k and the number."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def blocks(count: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Slices of consecutive entries with ``most`` candidates together, or one entry with more."""
    total = np.cumsum(count)
    begin = 0
    while begin < len(count):
        before = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, before + most, "right")), begin + 1)
        yield slice(begin, end)
        begin = end


class Ladder:
    """Ascending values of many segments on one axis, so that a search in all of them is one call."""

    def __init__(self, segment: np.ndarray, value: np.ndarray, base: np.ndarray, width: float) -> None:
        """``base``: where each row's segment begins; no value or query lies ``width`` from there or more."""
        self.step = 2.0 * width
        self.keys = segment * self.step + (value - base)

    def span(self, segment: np.ndarray, base: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place and the number of the values from ``low`` to ``high`` within each query's segment, and a little beyond."""
        at = segment * self.step - base
        first = np.searchsorted(self.keys, at + np.maximum(low - SLACK, base))
        return first, np.maximum(np.searchsorted(self.keys, at + high + SLACK, "right") - first, 0)
