import pytest
from pyspark.sql import functions as F

from denovospark.functions import params
from denovospark.functions import scalars as S
from denovospark.operators import candidates as C
from denovospark.operators import enumeration, labels, peaks, symmetry
from denovospark.plans import pipeline


def test_orientation(spark):
    rows = spark.createDataFrame([(1, ["b H2O1"]), (2, ["y"]), (3, ["", "H3N1"]), (4, ["y", "b"]), (5, ["b y"])], "id int, symbols array<string>")
    got = sorted((r.id, r.kind, r.at) for r in C.oriented(rows).collect())
    assert got == [(1, "prefix", 0), (2, "suffix", 0), (3, "infix", -1), (4, "prefix", 1), (4, "suffix", 0), (5, "infix", -1)]


def test_disjoint_edges(spark):
    rows = spark.createDataFrame([([1, 2, 3], [3, 2, 1]), ([1, 2, 3], [0, 2, 3]), ([1], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(S.edge_disjoint(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_pairing(spark):
    kinds = "g int, {} int, cost double, lower array<long>, upper array<long>"
    prefixes = spark.createDataFrame([(1, 1, 0.5, [10, 9], [20, 19]), (1, 2, 0.5, [11, 9], [20, 19])], kinds.format("prefix_id"))
    suffixes = spark.createDataFrame([(1, 1, 0.5, [21, 9], [12, 19]), (1, 3, 0.25, [21, 8], [12, 18]), (2, 4, 0.0, [21, 8], [12, 18])], kinds.format("suffix_id"))
    edges = spark.createDataFrame([(1, 10, 12, 5), (1, 12, 10, 5), (1, 20, 21, 6), (1, 21, 20, 6)], "g int, src long, dst long, pair_id long")
    got = C.pair_affixes(prefixes, suffixes, edges, ["g"]).collect()
    assert [(r.prefix_id, r.suffix_id, r.pair_uv, r.pair_wx) for r in got] == [(1, 3, 5, 6)]


def test_labels(spark):
    one = spark.createDataFrame([(1, 0, 10.0, "b", 1, [1], ["", "H2O1"]), (1, 1, 20.0, "y", 2, [2, 1], [""])], "spectrum int, idx long, mz double, series string, position int, charges array<int>, losses array<string>")
    two = one.withColumn("mz", F.col("mz") + 0.001).withColumn("charges", F.array(F.lit(1)))
    got = {r.idx: r for r in labels.compared(one, two, 0.01).collect()}
    assert len(got) == 2 and tuple(got[1].charge_aln) == (1, 0) and tuple(got[0].loss_aln) == (0, 0) and got[0].series_err
    assert labels.compared(one, two).count() == 0
    assert symmetry.fuzzy_join(one, two, 0.01, value="mz").count() == 2


def test_virtual_pivots_need_a_range(spark):
    from denovospark.operators import search

    points = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.1), (2, 0.1), (2, 10.0)], "spectrum int, point double")
    assert {r.spectrum for r in search.virtual_pivots(points, 1.0).collect()} <= {2}


def test_candidates_in_a_task_equal_joins(spark, monkeypatch):
    """Clusters of few walks take no join of walks; with any bound on walks, pairs or edges the candidates are the same."""
    ions = peaks.ions(spark.createDataFrame([("HHNIIR",), ("PEPTIDE",), ("TEST",)], "peptide string"))
    table = ions.select(F.col("peptide").alias("spectrum"), (F.col("position") * 2 + (F.col("series") == "y").cast("int")).alias("peak_id"), "mz", F.lit(1.0).alias("intensity"))
    a = pipeline.annotate(table, params.AnnotationParams(charges=(1, 2)))
    aligned = pipeline.align(a).cache()

    def found(limit=5.0, **more):
        rows = pipeline.enumerate_candidates(a, aligned, params.EnumerationParams(limit, **more)).collect()
        return {(r.spectrum, r.cluster_id, r["rank"]): (r.sequence, round(r.cost, 9), round(r.mass, 6), round(r.offset, 6)) for r in rows}

    traced, trace = [], pipeline.P.trace
    monkeypatch.setattr(pipeline.P, "trace", lambda *x: traced.append(x) or trace(*x))
    streamed = found()
    assert len(streamed) > 10 and not traced
    with pytest.raises(ValueError):
        found(max_paths=1)
    assert not traced
    monkeypatch.setattr(enumeration, "FEW", 0)
    assert found() == streamed and not traced
    monkeypatch.setattr(pipeline, "WALKS", 20)
    assert found() == streamed and len(traced) == 1  # some in a task, some by joins
    monkeypatch.setattr(pipeline, "WALKS", 50_000)
    monkeypatch.setattr(pipeline, "EDGES", 0)
    assert found() == streamed and len(traced) == 2
    assert found(0.0) == {}


def test_candidates_of_clusters_that_lack_something(spark):
    """One cluster has a candidate; others are without pivot edges, without a suffix, without product edges, without annotated edges, or have no rows at all."""
    product, noted = [], []
    for c in (1, 2, 3, 5):
        for halves in ((10, 20), (21, 12)):
            product += [(c, 0, -1, -1, *halves, 0.1), (c, 0, *halves, -2, -2, 0.0)]
    for c in (1, 2, 3, 4):
        noted += [(c, 0, "lower", -1, 10, 7, "A", 1.0, 0.1, 1), (c, 0, "upper", -1, 20, 8, "A", 1.0, 0.1, 1)]
        noted += [(c, 0, "lower", -1, 21, 7, "B", 2.0, 0.1, 1 if c == 3 else 2), (c, 0, "upper", -1, 12, 8, "C", 2.0, 0.1, 1 if c == 3 else 2)]
        noted += [(c, 0, "pivot", 10, 12, 5, "P", 3.0, 0.25, 0), (c, 0, "pivot", 20, 21, 6, "Q", 4.0, 0.5, 0)] if c != 2 else []
    key = "spectrum int, cluster_id int, "
    product = spark.createDataFrame(product, key + "src_low long, src_up long, dst_low long, dst_up long, cost double")
    noted = spark.createDataFrame(noted, key + "side string, src long, dst long, weight long, symbol string, mass double, cost double, ends int")
    for some in (None, 1, 2, 3, 4, 5, 6):  # together and each by itself
        of = lambda df: df if some is None else df.filter(F.col("spectrum") == some)  # noqa: B023, E731
        got = [(r.spectrum, r.cluster_id, r["rank"], r.sequence, round(r.cost, 9), r.mass) for r in enumeration.cheapest(of(product), of(noted), 2.0, 5, 100).collect()]
        assert got == ([(1, 0, 0, "APB/C", 0.45, 6.0)] if some in (None, 1) else [])
