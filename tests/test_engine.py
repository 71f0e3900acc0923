import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from denovospark.functions import dims, params
from denovospark.operators import bandjoin, peaks, search, symmetry
from denovospark.plans import pipeline

PEPTIDES = ["TEST", "PEPTIDE", "HHNIIR", "AEEHANR", "CEACPKPGTHAHK"]


def spectra(spark, names, charge=1):
    table = spark.createDataFrame([(p,) for p in names], "peptide string")
    ions = peaks.ions(table, charge)
    from pyspark.sql import Window as W

    return ions.select(F.col("peptide").alias("spectrum"), (F.row_number().over(W.partitionBy("peptide").orderBy("mz")) - 1).alias("peak_id"), "mz", F.lit(1.0).alias("intensity"), "series", "position", "charge")


def test_ions(spark):
    got = {(r.series, r.position): round(r.mz, 5) for r in spectra(spark, ["PEPTIDE"]).collect()}
    assert [got["b", i] for i in range(1, 7)] == [98.06004, 227.10263, 324.15540, 425.20308, 538.28714, 653.31408]
    assert [got["y", i] for i in range(1, 7)] == [148.06043, 263.08738, 376.17144, 477.21912, 574.27188, 703.31448]
    pivot = peaks.true_pivots(peaks.ions(spark.createDataFrame([("PEPTIDE",)], "peptide string"))).first().pivot
    assert abs(pivot - 400.68726) < 1e-5


def test_target_tables(spark):
    counts = {r["kind"]: (r["n"], r["d"]) for r in dims.all_targets(spark).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("mass").alias("d")).collect()}
    assert counts == {"pair": (575, 478), "boundary": (230, 202), "reflected": (230, 198)}
    assert dims.targets(spark, "boundary", conditional_losses=True).count() < 230
    two = dims.combined_masses(spark, "boundary", 2)
    assert two.agg(F.sum("n")).first()[0] == 230 * 230


# (peptide, most charge of an ion, charges tried) -> masses, pairs, pair hits, quadruples, clusters
GOLDEN = {("TEST", 1, (1,)): (6, 8, 46, 2, 1), ("PEPTIDE", 1, (1,)): (12, 17, 84, 1, 1), ("PEPTIDE", 1, (1, 2, 3)): (36, 46, 142, 2, 2), ("HHNIIR", 1, (1, 2, 3)): (30, 18, 101, 2, 2), ("TEST", 3, (1, 2, 3)): (54, 179, 646, 242, 13), ("HHNIIR", 3, (1, 2, 3)): (90, 206, 937, 379, 31)}


@pytest.mark.parametrize("case", GOLDEN, ids=str)
def test_golden_counts(spark, case):
    name, most, charges = case
    aug = peaks.augment(spectra(spark, [name], most), charges).cache()
    targets = dims.targets(spark, "pair")
    pairs = search.find_pairs(aug, targets, 0.015).cache()
    quads = search.overlap_pivots(aug, pairs, 0.015)
    clusters = search.clustered(quads)
    assert (aug.count(), pairs.select("i", "j").distinct().count(), pairs.count(), quads.count(), clusters.count()) == GOLDEN[case]


def test_true_pivot_is_found(spark):
    table = spectra(spark, PEPTIDES)
    aug = peaks.augment(table, (1, 2, 3)).cache()
    points = search.clustered(search.overlap_pivots(aug, search.find_pairs(aug, dims.targets(spark, "pair"), 0.015), 0.015)).cache()
    kept = symmetry.screened(symmetry.scored(symmetry.symmetries(aug, points, 0.015), points), 0.33)
    true = {r.peptide: r.pivot for r in peaks.true_pivots(peaks.ions(spark.createDataFrame([(p,) for p in PEPTIDES], "peptide string"))).collect()}
    found = kept.groupBy("spectrum").agg(F.collect_list("point").alias("p")).collect()
    assert {r.spectrum for r in found} == set(PEPTIDES)
    assert all(min(abs(x - true[r.spectrum]) for x in r.p) < 0.01 for r in found)


def test_band_join_equals_cross_join(spark):
    left = spark.range(200).select(F.col("id").alias("a"), (F.rand(1) * 20 - 10).alias("v"))
    right = spark.range(200).select(F.col("id").alias("b"), (F.rand(2) * 20 - 10).alias("t"))
    left, right = left.cache(), right.cache()
    for rows in (None, 200):
        got = {(r.a, r.b) for r in bandjoin.band_join(left, right, "v", "t", 0.3, right_rows=rows).collect()}
        want = {(r.a, r.b) for r in left.crossJoin(right).filter("t >= v - 0.3D and t <= v + 0.3D").collect()}
        assert got == want
    close = bandjoin.gap_join(left.select(F.lit(1).alias("g"), "a", "v"), ["g"], "v", 0.5, 2.5, ["a1", "v1"], ["a2", "v2"]).count()
    values = sorted(r.v for r in left.collect())
    assert close == sum(0.5 <= y - x <= 2.5 for x, y in itertools.permutations(values, 2))


def test_merge_match():
    assert symmetry.merge_match([5.0, 3.0, 1.0], [5.01, 2.99, 0.5], 0.05) == [(0, 0), (1, 1)]
    assert symmetry.merge_match([5.0, 4.98, 1.0], [5.0], 0.05) == [(0, 0)]
    assert symmetry.merge_match([5.0, 4.98, 1.0], [5.0, 4.99, 0.0], 0.03) == [(0, 0), (1, 1)]
    assert symmetry.fuzzy_matches([1.0, 2.0, 3.0], [1.004, 1.006, 3.2], 0.005) == [(0, 0)]
    assert symmetry.merge_match([5.0, 4.99], [5.0], 0.03) == [(0, 0)] and symmetry.merge_match([5.0, 4.99], [5.0], 0.03, (False, True)) == [(0, 0), (1, 0)]


def test_pipeline_labels_every_peak_and_aligns(spark):
    a = pipeline.annotate(spectra(spark, ["TEST", "HHNIIR"]).select("spectrum", "peak_id", "mz", "intensity"), params.AnnotationParams(charges=(1,)))
    labelled = a.labels.select("spectrum", "peak_id").distinct().groupBy("spectrum").count().collect()
    assert {r["spectrum"]: r["count"] for r in labelled} == {"TEST": 6, "HHNIIR": 10}
    assert {r[0] for r in a.edges.select("side").distinct().collect()} == {"lower", "upper", "pivot"}
    aligned = pipeline.align(a, params.AlignmentParams(cost_threshold=8.0)).cache()
    assert aligned.count() > 0
    found = pipeline.enumerate_candidates(a, aligned, params.EnumerationParams(cost_threshold=8.0))
    assert found.columns == ["spectrum", "cluster_id", "sequence", "cost", "mass", "offset", "rank"]
    spelled = {(r.spectrum, r.rank): r.sequence for r in found.collect()}
    assert spelled["HHNIIR", 0] == "HHNLLR"  # L and I have one mass
    assert "TEST" in spelled.values()


def test_pipeline_on_nothing(spark):
    none = spark.createDataFrame([], "spectrum string, peak_id int, mz double, intensity double")
    a = pipeline.annotate(none)
    assert a.edges.count() == 0 and pipeline.align(a).count() == 0


def test_targets_of_two_residues_are_annotated(spark):
    """Pairs two residues apart, and both ends two residues in, are among the hits, with the residues that they are."""
    table = spectra(spark, ["PEPTIDE", "AEEHANR"])
    a = pipeline.annotate(table.select("spectrum", "peak_id", "mz", "intensity"), params.AnnotationParams(charges=(1,), max_k=2))
    assert set(a.multi) == {("pair", 2), ("lower", 2), ("upper", 2)}
    ions = {(r.spectrum, r.peak_id): (r.series, r.position) for r in table.collect()}
    letters = lambda ids: "".join(sorted(params.AMINOS[i][0] for i in ids))
    lower = {(r.spectrum, *ions[r.spectrum, r.peak_id], letters(r.amino_ids)) for r in a.multi["lower", 2].select("spectrum", "peak_id", "amino_ids").distinct().collect()}
    upper = {(r.spectrum, *ions[r.spectrum, r.peak_id], letters(r.amino_ids)) for r in a.multi["upper", 2].select("spectrum", "peak_id", "amino_ids").distinct().collect()}
    pairs = {(r.spectrum, *ions[r.spectrum, r.left_peak], *ions[r.spectrum, r.right_peak], letters(r.amino_ids)) for r in a.multi["pair", 2].select("spectrum", "left_peak", "right_peak", "amino_ids").distinct().collect()}
    for p in ("PEPTIDE", "AEEHANR"):
        n, word = len(p), lambda s: "".join(sorted(s))
        assert (p, "b", 2, word(p[:2])) in lower and (p, "y", 2, word(p[-2:])) in lower
        assert (p, "b", n - 2, word(p[-2:])) in upper and (p, "y", n - 2, word(p[:2])) in upper
        assert all((p, "b", k, "b", k + 2, word(p[k : k + 2])) in pairs for k in range(1, n - 2))
    with pytest.raises(ValueError):
        params.AnnotationParams(max_k=0)


def test_generated_ions(spark):
    table = spark.createDataFrame([("PEPTIDE",), ("A",)], "peptide string")
    simple = peaks.generated(table).collect()
    assert {(r.series, r.position, round(r.mz, 5)) for r in simple} == {(r.series, r.position, round(r.mz, 5)) for r in peaks.ions(table).collect()}
    got = {(r.series, r.position, r.loss, r.charge): r.mz for r in peaks.generated(table, params.IonParams(("b",), True, True, 2)).collect()}
    assert ("b", 1, "H2O1", 1) not in got and ("b", 2, "H2O1", 1) in got and ("b", 2, "H3N1", 1) not in got and not any(k[0] == "y" for k in got)
    assert abs(got["b", 2, "", 1] - got["b", 2, "H2O1", 1] - 18.010564684) < 1e-9
    assert abs(got["p", 7, "", 1] - 800.3672) < 1e-3 and abs(2 * got["p", 7, "", 2] - got["p", 7, "", 1] - 1.007276466) < 1e-9 and ("p", 7, "H3N1", 2) in got


def test_candidates_weigh_what_they_are_made_of(spark):
    """A candidate's mass holds losses and modifications, so the right sequence's is twice the pivot."""
    found = pipeline.enumerate_candidates(a := pipeline.annotate(spectra(spark, ["PEPTIDE"]).select("spectrum", "peak_id", "mz", "intensity"), params.AnnotationParams(charges=(1,))), pipeline.align(a))
    best = {r.sequence: r.offset for r in found.collect()}
    assert best and min(abs(x) for x in best.values()) < 0.05


def test_shared_folder_of_a_cluster():
    from types import SimpleNamespace

    from denovospark.functions import storage

    session = lambda master, path: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: path), sparkContext=SimpleNamespace(applicationId=master, master=master))
    assert storage.shared_dir(session("spark://x:7077", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(session(master, None))
    assert storage.shared_dir(session("local[4]", None)) == storage.shared_dir(session("local[4]", None))
