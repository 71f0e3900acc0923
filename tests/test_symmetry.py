"""Greedy matches by runs against matches of the whole lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from denovospark.operators import symmetry


@pytest.fixture(scope="module")
def peaks():
    """Groups of many densities, with ties; one holds most of the values."""
    draw = np.random.default_rng(2)
    out = []
    for group, (n, span) in enumerate([(40, 3.0), (60, 60.0), (3000, 900.0), (200, 2.0), (1, 1.0), (50, 900.0)]):
        masses = np.sort(np.round(draw.random(n) * span + 20, 3))
        out += [(group, i, float(m)) for i, m in enumerate(masses)]
    return out


def test_symmetries_equal_those_of_whole_lists(spark, peaks):
    points = [(g, round(float(m) + d, 2)) for g, i, m in peaks if i % 41 == 0 for d in (0.0, 1.37)] + [(g, 20.0) for g in range(6)] + [(9, 5.0)]
    points = sorted(set(points))
    tolerance, want = 0.015, set()
    for g, p in points:
        masses = np.array([m for k, _, m in peaks if k == g])
        low, high = int(np.searchsorted(masses, p, "left")), int(np.searchsorted(masses, p, "right"))
        below, above = masses[:low][::-1].tolist(), (2 * p - masses[high:]).tolist()
        want |= {(g, p, low - 1 - a, high + b, round(abs(above[b] - below[a]), 9)) for a, b in symmetry.merge_match(below, above, tolerance)}
    aug = spark.createDataFrame(peaks, "spectrum long, aug_idx int, mass double")
    got = symmetry.symmetries(aug, spark.createDataFrame(points + points[:3], "spectrum long, point double"), tolerance).collect()
    assert len(got) == len(want) > 500
    assert {(r.spectrum, r.point, r.low_idx, r.high_idx, round(r.delta, 9)) for r in got} == want


@pytest.mark.parametrize("tolerance", [0.002, 0.05])
def test_matches_equal_those_of_whole_lists(spark, peaks, tolerance):
    df = spark.createDataFrame(peaks, "spectrum long, idx long, mass double")
    one, two = df.filter("idx % 3 <> 0"), df.filter("idx % 3 <> 1").withColumn("mass", F.col("mass") + 0.001)
    lists, fuzzy = set(), []
    for g in range(6):
        a, b = ([(m + d, i) for k, i, m in peaks if k == g and i % 3 != x] for x, d in ((0, 0.0), (1, 0.001)))
        down = [sorted(x, reverse=True) for x in (a, b)]
        lists |= {(g, down[0][i][1], down[1][j][1]) for i, j in symmetry.merge_match([v for v, _ in down[0]], [v for v, _ in down[1]], tolerance)}
        up = [sorted(v for v, _ in x) for x in (a, b)]
        fuzzy += [(g, up[0][i], up[1][j]) for i, j in symmetry.fuzzy_matches(*up, tolerance)]
    got = symmetry.list_matches(one, two, ("spectrum",), "mass", "idx", tolerance).collect()
    assert len(got) == len(lists) and {(r.spectrum, r.idx, r.other_idx) for r in got} == lists
    assert sorted(map(tuple, symmetry.fuzzy_join(one, two, tolerance).collect())) == sorted(fuzzy)


def test_a_hot_group_is_cut_into_short_runs(spark):
    """A group of a million values: what is listed is a run, not the group, and its values are dealt by slices."""
    n = 1_000_000
    values = spark.range(n).select(F.lit(1).alias("spectrum"), F.when(F.col("id") % 2 == 0, "left").otherwise("right").alias("side"), ((F.col("id") - F.col("id") % 2) * 0.01).alias("v"), F.lit(0).alias("turn"), F.col("id").alias("i"))
    runs = symmetry.run_lists(values, ("spectrum",), 0.005)
    assert runs.agg(F.count("*"), F.max(F.size("left")), F.max(F.size("right"))).first() == (n // 2, 1, 1)
    assert symmetry.with_runs(values, ("spectrum",), 0.005).agg(F.countDistinct("run")).first()[0] == n // 2
    none = values.limit(0)
    assert symmetry.run_lists(none, ("spectrum",), 0.005).count() == 0
