"""Searches and matches in sorted streams: what is expanded within a task isn't shuffled, and the results are those of plain loops."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from denovospark.functions import dims
from denovospark.operators import labels, search, streams, symmetry
from denovospark.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def masses():
    draw = np.random.default_rng(8)
    out = []
    for group, (n, span) in enumerate([(40, 700.0), (90, 2500.0), (1, 1.0), (130, 260.0)]):
        out += [(f"s{group}", k, int(k // 2), 1, float(m)) for k, m in enumerate(np.sort(np.round(draw.random(n) * span, 2)))]
    return out


@pytest.fixture(scope="module")
def aug(spark, masses):
    rows = [*masses, (None, 0, 0, 1, 5.0), (None, 1, 1, 1, 5.0 + 57.021463735), ("nan", 0, 0, 1, float("nan")), ("nan", 1, 1, 1, float("inf"))]
    return spark.createDataFrame(rows, "spectrum string, aug_idx int, peak_id int, charge int, mass double")


def test_pairs_and_pivots_equal_plain_loops_and_join_nothing(spark, masses, aug):
    tolerance, targets = 0.015, dims.targets(spark, "pair")
    known = [(r.mass, r.amino_id) for r in targets.collect()]
    want, quads = [], set()
    for g in {m[0] for m in masses}:
        mine = [m for m in masses if m[0] == g]
        pairs = set()
        for a in mine:
            for b in mine:
                if a[1] < b[1] and a[2] != b[2]:
                    gap = b[4] - a[4]
                    hits = [x for t, x in known if gap - tolerance <= t <= gap + tolerance]
                    want += [(g, a[1], b[1], x) for x in hits]
                    if hits:
                        pairs.add((a[1], b[1]))
        v = [m[4] for m in mine]
        for i, i2 in pairs:
            quads |= {(g, i, j, i2, j2) for j in range(i + 1, i2) for j2 in range(i2 + 1, len(v)) if abs((v[i2] - v[i]) - (v[j2] - v[j])) < tolerance}
    found = search.find_pairs(aug, targets, tolerance, first_by=["amino_id"])
    rows = found.collect()
    assert sorted((r.spectrum, r.i, r.j, r.amino_id) for r in rows) == sorted(want) and len(want) > 100
    assert sum(r.first for r in rows) == len(set(want))
    got = search.overlap_pivots(aug, found, tolerance, dims.greatest_target(spark, "pair") + tolerance)
    assert sorted((r.spectrum, r.i, r.j, r.i2, r.j2) for r in got.collect()) == sorted(quads) and len(quads) > 20
    assert "Join" not in plan(got) and "Aggregate" not in plan(got)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_segments_are_whole_whatever_the_batches(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = spark.range(300).select((F.col("id") % 9).alias("g"), F.when(F.col("id") % 9 == 4, 1).otherwise(F.col("id") % 2).alias("h"), "id")

        def sizes(batches):
            for table, segment in streams.whole_segments(batches, ["g", "h"]):
                first = np.flatnonzero(np.diff(segment, prepend=-1))
                counts = np.diff(np.append(first, len(segment)))
                yield from table.select(["g", "h"]).take(first).append_column("n", [counts]).to_batches()

        got = streams.in_segments(rows, ["g", "h"], ["id"]).mapInArrow(sizes, "g long, h long, n long").collect()
        assert sorted(map(tuple, got)) == sorted((r.g, r.h, r.n) for r in rows.groupBy("g", "h").agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_groups_take_the_sliced_way_with_the_same_result(spark, aug, monkeypatch):
    points = spark.createDataFrame([(f"s{g}", p, 2) for g in range(4) for p in (20.0, 155.5, 333.33)], "spectrum string, point double, n int")
    whole = sorted(map(tuple, symmetry.symmetries(aug, points, 3.0).collect()))
    scores = lambda df: sorted((r.spectrum, r.point, r.n, round(r.score, 9), r.n_symmetries) for r in df.collect())
    plain = scores(symmetry.scored(symmetry.symmetries(aug, points, 3.0), points))
    assert scores(symmetry.symmetry_scores(aug, points, 3.0)) == plain and len(whole) > 50 and len(plain) == 12
    one = aug.filter("mass < 1e9").withColumn("idx", F.col("aug_idx").cast("long"))
    two = one.filter("aug_idx % 3 <> 0").withColumn("mass", F.col("mass") + 0.5)
    lists = sorted(map(tuple, symmetry.list_matches(one, two, ("spectrum",), "mass", "idx", 1.0).filter("spectrum is not null").collect()))
    monkeypatch.setattr(symmetry, "GROUP", 30)
    assert sorted(map(tuple, symmetry.symmetries(aug, points, 3.0).collect())) == whole
    assert scores(symmetry.symmetry_scores(aug, points, 3.0)) == plain
    assert sorted(map(tuple, symmetry.list_matches(one, two, ("spectrum",), "mass", "idx", 1.0).filter("spectrum is not null").collect())) == lists


def test_labels_are_added_up_without_lists(spark):
    """labelled_peaks makes its pairs once and lists no labels."""
    df = registry.labelled_peaks(spark, "/root/testdata/sf0.001")
    assert plan(df).count("MapInArrow") == 1 and "collect_list" not in plan(df)
    hits = registry.event_pair_hits(spark, "/root/testdata/sf0.001")
    assert "Expand" not in plan(hits) and plan(hits).count("Aggregate [") == 1
    assert labels.pair_ends(registry.event_pair_table(spark, "/root/testdata/sf0.001")).columns == ["spectrum", "peak_id", "charge", "cost", "loss_id"]


@pytest.mark.parametrize("name", ["label_comparison", "noisy_comparison"])
def test_comparisons_read_the_documents_once(spark, name):
    from denovospark.plans import comparisons  # noqa: F401  it registers queries

    assert "string_split" not in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001")) and "split(replace" not in plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["label_comparison", "noisy_comparison"])
def test_comparisons_broadcast_nothing(spark, name):
    """Labels are expanded from a small file of words, so Spark takes them for small."""
    from denovospark.plans import comparisons  # noqa: F401  it registers queries

    text = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and text.count("SortMergeJoin") == {"label_comparison": 1, "noisy_comparison": 2}[name]


def test_matches_of_two_shuffled_sides_are_whole(spark):
    """Each side is dealt by its window already; Spark merges their partitions apart when they are of another size."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.shuffle.partitions")}
    order = W.partitionBy("spectrum").orderBy("mz")
    table = spark.range(24_000).select((F.col("id") % 3000).cast("string").alias("spectrum"), F.floor(F.col("id") / 3000).cast("double").alias("mz"), F.repeat(F.col("id").cast("string"), 9).alias("note"))
    side = lambda rows: rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    try:
        for k, v in zip(held, ("64k", "1b", "12"), strict=True):
            spark.conf.set(k, v)
        found = symmetry.list_matches(side(table), side(table.filter("mz % 4 = 1")), ("spectrum",), "mz", "idx", 1e-9, ("note",)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(found) == 6000 and {(r.idx, r.other_idx) for r in found} == {(1, 0), (5, 1)} and all(r.note == r.other_note for r in found)


def test_columns_are_carried_alike_in_streams_and_by_joins(spark, monkeypatch):
    draw = np.random.default_rng(8)
    rows = lambda n, seed: spark.createDataFrame([(s, k, float(m), [int(m), k], f"{seed}{s}{k}") for s in "ab" for k, m in enumerate(np.sort(draw.uniform(0, 60, n)))], "spectrum string, idx long, mass double, at array<int>, name string")
    one, two = rows(40, "x"), rows(30, "y")
    found = lambda: sorted(tuple(map(str, r)) for r in symmetry.list_matches(one, two, ("spectrum",), "mass", "idx", 0.7, ("at", "name")).collect())
    want = found()
    monkeypatch.setattr(symmetry, "GROUP", 30)
    assert len(want) > 20 and found() == want and all(r[4] == f"x{r[0]}{r[1]}" and r[6] == f"y{r[0]}{r[2]}" for r in want)


def test_clusters_are_aligned_alike_in_streams_and_by_joins(spark, monkeypatch):
    from denovospark.functions.params import AlignmentParams
    from denovospark.operators import product

    draw = np.random.default_rng(3)
    edges, hits = [], []
    for cluster in range(3):
        for side in ("lower", "upper"):
            for a, b in sorted({(-1, int(x)) for x in draw.integers(0, 7, 3)} | {(int(x), -2) for x in draw.integers(0, 7, 2)} | {(int(min(x)), int(max(x))) for x in draw.integers(0, 7, (9, 2)) if x[0] != x[1]}):
                edges.append(("w", cluster, side, a, b, len(edges) if b != -2 else -1))
                hits += [("w", "boundary" if a < 0 else "pair", len(edges) - 1, float(c) / 4, 1, int(c), 0, 0) for c in draw.integers(0, 5, draw.integers(0, 3))] if b != -2 else []
    tables = [
        spark.createDataFrame(edges, "spectrum string, cluster_id int, side string, src long, dst long, weight long"),
        spark.createDataFrame(hits, "spectrum string, src string, id long, cost double, amino_id int, left_loss_id int, right_loss_id int, mod_id int"),
        spark.createDataFrame([("w", 0, 1, 1), ("w", 0, 40, 2), ("other", 0, 1, 1)], "spectrum string, cluster_id int, low int, high int"),
    ]
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in product.align(*tables, AlignmentParams(cost_threshold=5.0)).collect())
    streamed = product.align(*tables, AlignmentParams(cost_threshold=5.0))
    assert "MapInArrow" in plan(streamed) and "Join" not in plan(streamed)
    want = rows()
    monkeypatch.setattr(product, "SMALL", 27)
    some = rows()
    monkeypatch.setattr(product, "SMALL", 0)
    assert want == some == rows() and len(want) > 40
