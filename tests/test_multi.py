"""Targets of several residues against the full product, and the recall of the residues that a peptide begins and ends with."""

import itertools

import pytest
from pyspark.sql import functions as F

from denovospark.functions import dims, params
from denovospark.operators import multi, peaks

SYMBOLS = [s for s, _ in params.AMINOS]


@pytest.mark.parametrize("kind", ["pair", "boundary", "reflected"])
def test_two_residues_equal_the_product(spark, kind):
    one, pair = (dims.targets(spark, x).collect() for x in (kind, "pair"))
    values = [(i, v, "x") for i, v in enumerate([130.05, 228.1113, 400.25, 371.2, 9.0, 257.12])] + [(0, 130.05, "x"), (None, 228.1113, "x")]
    want = []
    for i, v, _ in values:
        for a, b in itertools.product(one, pair):
            if v - 0.015 <= (target := b.mass + a.mass) <= v + 0.015:
                complexity = int(b.left_loss_id != 0 or a.left_loss_id != 0) + int(a.right_loss_id % 5 != 0 or b.right_loss_id != 0) + int(a.mod_id != 0 or b.mod_id != 0)
                want.append((i, (a.amino_id, b.amino_id), (a.left_loss_id, b.left_loss_id), (a.right_loss_id, b.right_loss_id), (a.mod_id, b.mod_id), round(abs(v - target) * (1 + complexity), 9)))
    got = multi.find_multi(spark.createDataFrame(values, "id int, m double, cost_of string"), "m", kind, 2, 0.015).collect()
    assert sorted(map(str, want)) == sorted(str((r.id, *(tuple(r[s]) for s in multi.STATES), round(r.cost, 9))) for r in got) and len(want) > 50


@pytest.mark.parametrize("k", [2, 3])
def test_recall_of_boundaries(spark, k):
    names = ["TEST", "PEPTIDE", "HHNIIR", "AEEHANR", "NREQSTK"]
    ions = peaks.ions(spark.createDataFrame([(p,) for p in names], "peptide string")).filter(F.col("position") == k)
    found = multi.find_multi(ions.select("peptide", "series", "mz"), "mz", "boundary", k, 0.01).select("peptide", "series", "amino_ids").distinct().collect()
    spelled = {(r.peptide, r.series, "".join(sorted(SYMBOLS[a] for a in r.amino_ids))) for r in found}
    for p in names:
        assert (p, "b", "".join(sorted(p[:k]))) in spelled and (p, "y", "".join(sorted(p[-k:]))) in spelled


def test_of_nothing(spark):
    assert multi.find_multi(spark.createDataFrame([], "m double"), "m", "pair", 2, 0.015).count() == 0
