"""Spectra annotated within a task are annotated as by joins."""

import numpy as np
from pyspark.sql import functions as F

from denovospark.functions import params
from denovospark.operators import annotation, peaks
from denovospark.plans import pipeline, registry, words


def test_streams_equal_joins(spark, monkeypatch):
    draw = np.random.default_rng(5)
    ions = peaks.ions(spark.createDataFrame([("PEPTIDE",), ("HHNIIR",), ("GG",)], "peptide string"))
    table = ions.select(F.col("peptide").alias("spectrum"), (F.col("position") * 2 + (F.col("series") == "y").cast("int")).alias("peak_id"), "mz", F.lit(1.0).alias("intensity"))
    noise = [("noise", k, float(m), 1.0) for k, m in enumerate(np.round(draw.uniform(-20, 500, 40), 2))] + [("odd", 0, 57.0, 1.0), ("odd", 1, float("nan"), 1.0), ("odd", 2, None, 1.0)]
    table = table.unionByName(spark.createDataFrame(noise, "spectrum string, peak_id int, mz double, intensity double"))
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    flat = lambda a: a.noted.select("spectrum", "cluster_id", "side", "src", "dst", "weight", F.explode_outer("hits").alias("h")).select("*", "h.*").drop("h")
    every = lambda a: [rows(x) for x in (a.nodes, a.clusters, a.paired_peaks, a.edges, flat(a))]

    streamed = every(pipeline.annotate(table, params.AnnotationParams(charges=(1, 2))))
    monkeypatch.setattr(annotation, "PEAKS", 11)  # the noise and PEPTIDE by joins
    some = pipeline.annotate(table, params.AnnotationParams(charges=(1, 2)))
    assert {r[0] for r in some._large.peaks.select("spectrum").distinct().collect()} == {"noise", "PEPTIDE"}
    assert every(some) == streamed and all(len(x) > 10 for x in streamed[::2]) and {r[0] for r in streamed[3]} >= {"noise", "PEPTIDE", "HHNIIR"}


def test_annotated_words_are_shuffled_as_peaks_alone(spark):
    plan = words.annotated_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan and "annotated_words" in registry.QUERIES
