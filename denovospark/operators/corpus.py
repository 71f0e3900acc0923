"""Substring search in a corpus of sequences, as k-mer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import params as P
from ..functions.scalars import in_alphabet
from ..functions.storage import materialize
from .bandjoin import band_join
from .peaks import residue_masses


def kmers(corpus: DataFrame, k: int, text: str = "peptide") -> DataFrame:
    """(kmer, at, text): every run of ``k`` characters; runs don't cross sequences."""
    rows = corpus.filter(F.length(text) >= k).select(text, F.explode(F.sequence(F.lit(1), F.length(text) - k + 1)).alias("at"))
    return rows.select(F.substring(F.col(text), F.col("at"), F.lit(k)).alias("kmer"), "at", text)


def kmer_counts(corpus: DataFrame, k: int, text: str = "peptide") -> DataFrame:
    return kmers(corpus, k, text).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_index(corpus: DataFrame, least: int, most: int, text: str = "peptide") -> DataFrame:
    """(kmer, n) of all lengths from ``least`` to ``most``: what a suffix array answers, as a table to write bucketed by prefix."""
    rows = corpus.select(F.col(text).alias("t"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("k")).filter("length(t) >= k")
    return rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - F.col("k") + 1), lambda i: F.substring(F.col("t"), i, F.col("k")))).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def count_substrings(corpus: DataFrame, queries: DataFrame, text: str = "peptide") -> DataFrame:
    """(query, n): how often each query occurs, overlaps counted, 0 for none and for empty ones. One pass over the corpus, whatever the lengths.

    A query is anchored at its first letters, the greatest power of two of them. The corpus is cut at every place into pieces of twice an anchor less one, so an
    anchor that is found has the rest of its query beside it, to be compared as text.
    """
    wanted = queries.select("query").filter("query is not null").distinct()
    anchored = wanted.filter("query <> ''").withColumn("g", F.expr("shiftleft(1, length(bin(length(query))) - 1)")).withColumn("anchor", F.expr("left(query, g)"))
    sizes = sorted(r[0] for r in anchored.select("g").distinct().collect())  # at most the logarithm of the longest query
    if not sizes:
        return wanted.withColumn("n", F.lit(0).cast("long"))
    rows = corpus.select(F.col(text).alias("t"), F.explode(F.array(*map(F.lit, sizes))).alias("g")).filter("length(t) >= g")
    pieces = rows.select("g", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - F.col("g") + 1), lambda i: F.substring(F.col("t"), i, 2 * F.col("g") - 1))).alias("piece"))
    met = pieces.withColumn("anchor", F.expr("left(piece, g)")).join(anchored, ["g", "anchor"]).filter(F.startswith("piece", "query"))
    return wanted.join(met.groupBy("query").agg(F.count("*").alias("n")), "query", "left").fillna(0, ["n"])


def extensions(index: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, next, n): the characters that follow each prefix in the corpus, from a ``kmer_index``."""
    longer = index.select(F.expr("left(kmer, length(kmer) - 1)").alias("prefix"), F.right("kmer", F.lit(1)).alias("next"), "n")
    return longer.join(prefixes.select("prefix").distinct(), "prefix")


def all_kmers(spark: SparkSession, k: int) -> DataFrame:
    """All k-tuples of residues: (kmer, nano, mods): their mass and the modifications that apply to any of them."""
    one = spark.createDataFrame([(s, round(m * 1e9), [0, *P.MODS_OF.get(i, [])]) for i, (s, m) in enumerate(P.AMINOS)], "s string, m long, a array<int>")
    out = one.select(F.col("s").alias("kmer"), F.col("m").alias("nano"), F.col("a").alias("mods"))
    for _ in range(k - 1):
        out = out.crossJoin(F.broadcast(one)).select(F.concat("kmer", "s").alias("kmer"), (F.col("nano") + F.col("m")).alias("nano"), F.array_sort(F.array_distinct(F.concat("mods", "a"))).alias("mods"))
    return out


def unordered(kmer_table: DataFrame, corpus_counts: DataFrame) -> DataFrame:
    """Multisets of the k-mers that occur in the corpus, and the number of orders in which each does."""
    return kmer_table.join(corpus_counts.select("kmer"), "kmer", "left_semi").select(F.array_join(F.array_sort(F.filter(F.split("kmer", ""), lambda c: c != "")), "").alias("multiset")).groupBy("multiset").agg(F.count("*").alias("n_orders"))


def by_mass(kmer_table: DataFrame) -> DataFrame:
    """k-mers of exactly equal mass."""
    return kmer_table.groupBy("nano").agg(F.count("*").alias("n"), F.min("kmer").alias("first"))


def query_mass(corpus: DataFrame, masses: DataFrame, tolerance: float, text: str = "peptide") -> DataFrame:
    """(mass, segment, segment_mass): distinct substrings of any length whose mass is strictly within tolerance of a query's.

    A segment's mass is a difference of two prefix sums, so each prefix and each queried mass ask for another prefix of the same sequence in a band join:
    no segment is listed that doesn't match. Sequences with other letters than residues are left out. The queried masses are a stated set.
    """
    whole = corpus.filter(in_alphabet(F.col(text)) & (F.length(text) > 0)).select(F.col(text).alias("t")).distinct()
    whole = materialize(whole.withColumn("of", F.monotonically_increasing_id()), "mass-sequences")  # written, so that the numbers stay
    zero = F.lit(0).cast("long")
    sums = whole.select("of", F.posexplode(residue_masses(F.col("t"))).alias("at", "m"))
    nano = F.sum("m").over(W.partitionBy("of").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.select("of", (F.col("at") + 1).alias("at"), nano.alias("nano")).unionByName(whole.select("of", F.lit(0).alias("at"), zero.alias("nano")))
    starts = sums.select("of", F.col("at").alias("begin"), F.col("nano").alias("below")).crossJoin(masses.select("mass").distinct()).withColumn("goal", F.col("below") / F.lit(1e9) + F.col("mass"))
    ends = sums.select("of", F.col("at").alias("end"), F.col("nano").alias("above"), (F.col("nano") / F.lit(1e9)).alias("total"))
    met = band_join(starts, ends, "goal", "total", tolerance + 1e-6, on=["of"])
    met = met.withColumn("segment_mass", (F.col("above") - F.col("below")) / F.lit(1e9))
    met = met.filter((F.abs(F.col("segment_mass") - F.col("mass")) < tolerance) & (F.col("end") > F.col("begin")))
    segment = F.substring(F.col("t"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    return met.join(whole, "of").select("mass", segment.alias("segment"), "segment_mass").distinct()


def ranked_suffixes(corpus: DataFrame, length: int, text: str = "peptide") -> DataFrame:
    """(suffix, n, below): distinct suffixes cut to ``length``, how often each occurs, and how many suffixes sort before it.

    The order is found among distinct first characters, then within each, so no task sorts all suffixes.
    """
    cut = corpus.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(F.col(text), i, F.lit(length)))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))
    cut = cut.withColumn("head", F.left("suffix", F.lit(2)))
    heads = cut.groupBy("head").agg(F.sum("n").alias("size"))
    starts = heads.withColumn("start", F.coalesce(F.sum("size").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("size")
    within = F.coalesce(F.sum("n").over(W.partitionBy("head").orderBy("suffix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("within", within).join(F.broadcast(starts), "head").select("suffix", "n", (F.col("start") + F.col("within")).alias("below"))
