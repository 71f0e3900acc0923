"""Substring and mass queries against plain loops."""

import random

from pyspark.sql import functions as F

from denovospark.functions import params
from denovospark.operators import corpus

MASSES = {s: round(m * 1e9) for s, m in params.AMINOS}


def sequences(n, longest):
    draw = random.Random(n)
    return ["".join(draw.choice("GASPVTLK") for _ in range(draw.randrange(1, longest))) for _ in range(n)]


def test_counts_of_all_lengths_in_one_pass(spark):
    texts = [*sequences(60, 40), "A", "AAAAAAA", "", None]
    queries = ["A", "AA", "AAA", "GA", "S", texts[0], texts[1][:9], texts[2][1:6], "KKKKKKKKKKKKKKKKKKKK", "", None, "A"]
    df = spark.createDataFrame([(t,) for t in texts], "peptide string")
    got = corpus.count_substrings(df, spark.createDataFrame([(q,) for q in queries], "query string"))
    count = lambda q: sum(t.startswith(q, k) for t in texts if t for k in range(len(t))) if q else 0
    assert sorted(map(tuple, got.collect())) == sorted((q, count(q)) for q in {q for q in queries if q is not None})
    assert corpus.count_substrings(df, df.limit(0).withColumnRenamed("peptide", "query")).count() == 0


def test_one_scan_whatever_the_lengths(spark, tmp_path):
    spark.createDataFrame([(t,) for t in sequences(30, 20)], "peptide string").write.parquet(str(tmp_path / "corpus"))
    queries = spark.createDataFrame([("G" * k,) for k in range(1, 12)], "query string")
    plan = corpus.count_substrings(spark.read.parquet(str(tmp_path / "corpus")), queries)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert plan.count("parquet") == 1


def test_segments_of_any_length(spark):
    texts = [*sequences(25, 90), "G" * 60, "B", ""]
    wanted = [57.02, 300.0, 1000.1, 3421.28, 5000.0]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "peptide string")
    got = {(r.mass, r.segment) for r in corpus.query_mass(df, spark.createDataFrame([(m,) for m in [*wanted, 300.0]], "mass double"), 0.4).collect()}
    want = set()
    for t in texts:
        if t and all(c in MASSES for c in t):
            for i in range(len(t)):
                total = 0
                for j in range(i, len(t)):
                    total += MASSES[t[j]]
                    want |= {(m, t[i : j + 1]) for m in wanted if abs(total / 1e9 - m) < 0.4}
    assert got == want and max(len(s) for _, s in got) > 40
    assert corpus.query_mass(df.filter(F.lit(False)), spark.createDataFrame([(1.0,)], "mass double"), 0.4).count() == 0
