"""Joins on |difference| within a tolerance, as equi-joins of buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which the right side is broadcast.
BROADCAST_ROWS = 100_000


def band_join(
    left: DataFrame, right: DataFrame, value: str, target: str, tolerance: float, on: list[str] = (), width: float | None = None, strict: bool = False, right_rows: int | None = None
) -> DataFrame:
    """Rows of both sides with value - tolerance <= target <= value + tolerance (strictly, if so asked) and equal ``on``.

    One side lies in one bucket of ``width`` (4 tolerances, unless given), the other is repeated for the buckets that its band
    meets, so a match is found once. With ``right_rows`` known and small the right side is broadcast, and it is the one that is
    repeated: the left side is neither shuffled nor multiplied. Else the left side is repeated and both are shuffled by the bucket.
    """
    width = max(4 * tolerance, 1e-6) if width is None else width
    if width < tolerance:
        raise ValueError("buckets have to be wider than the tolerance")
    place = lambda x: F.floor(x / F.lit(width))
    # a little wider than the condition, whose sums are rounded in another order
    reach = tolerance * (1 + 1e-6) + 1e-9
    spread = lambda x: F.explode(F.sequence(place(x - F.lit(reach)), place(x + F.lit(reach))))
    v, t = F.col(value), F.col(target)
    within: Column = (F.abs(v - t) < F.lit(tolerance)) if strict else (t >= v - F.lit(tolerance)) & (t <= v + F.lit(tolerance))
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        one, other = left.withColumn("_bucket", place(v)), F.broadcast(right.withColumn("_bucket", spread(t)))
    else:
        one, other = left.withColumn("_bucket", spread(v)), right.withColumn("_bucket", place(t))
    return one.join(other, [*on, "_bucket"]).filter(within).drop("_bucket")


def gap_join(peaks: DataFrame, on: list[str], value: str, least: float, most: float, left: list[str], right: list[str]) -> DataFrame:
    """Ordered pairs of peaks of one group whose gap lies in [least, most], by buckets as wide as the longest gap.

    A pair's members are in one bucket or in neighbouring ones, so a dense group is dealt to as many tasks as it has buckets.
    ``left`` and ``right`` rename the columns besides ``on``, in order.
    """
    rest = [c for c in peaks.columns if c not in on]
    width = F.lit(max(most, 1e-9))
    place = F.floor(F.col(value) / width)
    one = peaks.withColumn("_bucket", F.explode(F.array(place, place + 1)))
    one = one.select(*on, "_bucket", *(F.col(c).alias(n) for c, n in zip(rest, left, strict=True)))
    two = peaks.withColumn("_bucket", place).select(*on, "_bucket", *(F.col(c).alias(n) for c, n in zip(rest, right, strict=True)))
    gap = F.col(right[rest.index(value)]) - F.col(left[rest.index(value)])
    return one.join(two, [*on, "_bucket"]).filter((gap >= F.lit(least)) & (gap <= F.lit(most))).drop("_bucket")
