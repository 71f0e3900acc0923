"""Queries of generated spectra, clustered targets, comparisons of labellings and greedy matches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import params as P
from ..functions import scalars as S
from ..functions.storage import materialize
from ..operators import labels as L
from ..operators import peaks, search, symmetry
from . import registry as R
from .registry import query

_M = R._MICRO


@query(f"""SELECT kind, trunc(mass / 0.01::DOUBLE)::BIGINT AS bucket, min(id)::INT AS first, max(id)::INT AS last, count(*) AS n FROM (
  SELECT kind, mass, row_number() OVER (PARTITION BY kind ORDER BY mass, amino_id, left_loss_id, right_loss_id, mod_id) - 1 AS id FROM (
    {' UNION ALL '.join(f"SELECT '{k}' AS kind, * FROM {R._targets(k)}" for k in ("pair", "boundary", "reflected"))})) GROUP BY ALL""")
def clustered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.target_clusters(dims.all_targets(spark), 0.01)


_FRAGMENTS = f"""(SELECT peptide, 'b' AS series, i AS position, sum(nano) OVER (PARTITION BY peptide ORDER BY i)::BIGINT AS nano, substr(peptide, 1, i::INT) AS part FROM {R._RESIDUES}
  UNION ALL SELECT peptide, 'y', length(peptide) - i + 1, (sum(nano) OVER (PARTITION BY peptide ORDER BY i DESC) + {P.WATER_N})::BIGINT, substr(peptide, i::INT) FROM {R._RESIDUES})"""
_LOST = " UNION ALL ".join(f"SELECT '{x}' AS loss, '[{r}]' AS residues, {P.NEUTRAL_N[x]} AS less" for x, r in P.LOSES.items())


@query(f"""WITH f AS (SELECT * FROM {_FRAGMENTS} WHERE position < length(peptide) UNION ALL SELECT peptide, 'p', position, nano, '{"".join(P.LOSES.values())}' FROM {_FRAGMENTS} WHERE series = 'y' AND position = length(peptide)),
 l AS (SELECT f.*, '' AS loss, 0 AS less FROM f UNION ALL SELECT f.*, loss, less FROM f JOIN ({_LOST}) x ON regexp_matches(part, residues)), c AS (SELECT l.*, unnest([1, 2]) AS charge FROM l)
 SELECT series, position::INT AS position, loss, charge, count(*) AS n, sum({_M.format(f'((nano - less + charge * {P.PROTON_N}) / 1e9::DOUBLE / charge)')})::BIGINT AS mz_u FROM c GROUP BY ALL""")
def generated_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ions with losses and precursors at two charges, added up by name over all words."""
    ions = peaks.generated(R.words(spark, sf_dir), P.IonParams(losses=True, precursors=True, max_charge=2))
    return ions.groupBy("series", "position", "loss", "charge").agg(F.count("*").alias("n"), F.sum(S.micro(F.col("mz"))).alias("mz_u"))


_ISLANDS = f"""(WITH i AS (SELECT *, avg(CASE WHEN series = 'b' AND position <= 2 OR series = 'y' AND position >= length(peptide) - 2 THEN mz END) OVER (PARTITION BY peptide) AS pv FROM {R._IONS}),
 g AS (SELECT *, lag(mz) OVER w < pv AND pv < mz AS cut FROM i WINDOW w AS (PARTITION BY peptide, series ORDER BY position)),
 p AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY peptide, series ORDER BY position) AS path FROM g)
 SELECT peptide, series, path::BIGINT AS path, min(position) AS low, max(position) AS high FROM p GROUP BY ALL)"""


@query(f"""WITH b AS (SELECT * FROM {_ISLANDS} WHERE series = 'b'), y AS (SELECT * FROM {_ISLANDS} WHERE series = 'y')
 SELECT b.peptide, b.path AS b_path, y.path AS y_path, (b.high - b.low + 1)::INT AS n, (CASE WHEN b.high < y.low OR 2 * b.high < length(b.peptide) THEN b.low ELSE y.high END)::INT AS first
 FROM b JOIN y ON b.peptide = y.peptide AND y.high = length(b.peptide) - b.low AND y.low = length(b.peptide) - b.high""")
def true_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of b and y that spell the same residues; first is where the lower one begins."""
    ions = R.word_ion_table(spark, sf_dir)
    found = peaks.alignments(peaks.series_paths(ions, peaks.true_pivots(ions)))
    return found.select("peptide", "b_path", "y_path", F.size("lower").alias("n"), F.element_at("lower", 1).alias("first"))


#: The second labelling lacks every third position, takes y a position too far, and the other series at every fifth.
_OTHER = f"""(SELECT peptide, mz, CASE WHEN position % 5 = 0 THEN (CASE WHEN series = 'b' THEN 'y' ELSE 'b' END) ELSE series END AS series, position + (series = 'y')::INT AS position, CASE WHEN position % 2 = 0 THEN [2, 1] ELSE [3] END AS charges,
  2.0::DOUBLE * position AS intensity FROM {R._IONS} WHERE position % 3 <> 0)"""


@query(f"""SELECT a.peptide AS spectrum, any_value(length(a.peptide)) * 2 - 2 - count(*) AS mz_err, count(*) FILTER (a.series = b.series) AS n_same_series, sum(a.position - b.position)::BIGINT AS pos_err,
  count(*) FILTER (list_contains(b.charges, 1)) AS n_charges, sum(a.position - b.intensity) AS int_err, length(a.peptide) - 7 AS peptide_err, 1500000 AS pivot_u
 FROM {R._IONS} a JOIN {_OTHER} b USING (peptide, mz) GROUP BY a.peptide""")
def noisy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's ions against a labelling with peaks missing and labels changed; its peptide keeps seven letters, its pivot is 1.5 off."""
    ions = peaks.ions(materialize(R.words(spark, sf_dir), "words"))  # both labellings, the pivots and the lengths are made of it
    order = W.partitionBy("spectrum").orderBy("mz")
    numbered = lambda df: df.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    at = F.col("position")
    base = ions.select(F.col("peptide").alias("spectrum"), "mz", "series", "position")
    one = numbered(base.select("spectrum", "mz", "series", "position", F.array(F.lit(1)).alias("charges"), F.array(F.lit("")).alias("losses"), at.cast("double").alias("intensity")))
    swapped = F.when(at % 5 == 0, F.when(F.col("series") == "b", "y").otherwise("b")).otherwise(F.col("series"))
    two = base.filter(at % 3 != 0).select(
        "spectrum", "mz", swapped.alias("series"), (at + (F.col("series") == "y").cast("int")).alias("position"), F.when(at % 2 == 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(3))).alias("charges"),
        F.array(F.lit("")).alias("losses"), (at * 2.0).alias("intensity"),
    )
    aligned = L.compared(one, numbered(two))
    sums = [F.count(F.when(F.col("series_err"), 1)).alias("n_same_series"), F.sum("pos_err").alias("pos_err"), F.count(F.when(F.col("charge_aln.i") >= 0, 1)).alias("n_charges"), F.sum("int_err").alias("int_err")]
    pivots = peaks.true_pivots(ions).select(F.col("peptide").alias("spectrum"), "peptide", "pivot", (F.length("peptide").cast("long") * 2 - 2).alias("n"))
    other = pivots.select("spectrum", F.substring("peptide", 1, 7).alias("peptide"), (F.col("pivot") - 1.5).alias("pivot"))
    whole = L.compared_spectra(pivots, other, aligned, also=sums).filter("n_same_series is not null")  # those with aligned peaks
    return whole.select("spectrum", "mz_err", "n_same_series", "pos_err", "n_charges", "int_err", F.col("peptide_err").cast("long").alias("peptide_err"), S.micro(F.col("pivot_err")).cast("int").alias("pivot_u"))


R.ORACLE_SQL["fuzzy_matches"] = """WITH RECURSIVE l AS (SELECT user_id AS spectrum, list_sort(list(value)) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT user_id AS spectrum, list_sort(list(value)) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1),
 s AS (SELECT * FROM l JOIN r USING (spectrum)), g AS (SELECT spectrum, a, b, 0 AS i, 0::BIGINT AS j, 0::BIGINT AS m FROM s
  UNION ALL SELECT spectrum, a, b, i + 1, CASE WHEN hit THEN k ELSE k - 1 END, CASE WHEN hit THEN k ELSE 0 END FROM (
   SELECT *, k <= len(b) AND abs(b[k] - a[i + 1]) < 0.5 AS hit FROM (SELECT *, greatest(j, len([x FOR x IN b IF x <= a[i + 1] - 0.5::DOUBLE])) + 1 AS k FROM g WHERE i < len(a))))
 SELECT spectrum, a[i] AS "left", b[m] AS "right" FROM g WHERE m > 0"""


@query(f"""WITH RECURSIVE pts AS (SELECT spectrum, round_even(pv * 100.0::DOUBLE, 0) / 100.0 AS p, count(*) AS n FROM {R._QUADS} GROUP BY 1, 2),
 m AS (SELECT spectrum, list(mass ORDER BY aug_idx) AS v FROM {R._AUG} GROUP BY 1),
 s AS (SELECT spectrum, p, len([x FOR x IN v IF x < p]) AS low, len([x FOR x IN v IF x <= p]) AS high, len(v) AS most FROM pts JOIN m USING (spectrum)),
 w AS (SELECT spectrum, p, low, high, most, 0::BIGINT AS a, 0::BIGINT AS b, 'infinity'::DOUBLE AS la, 'infinity'::DOUBLE AS lb, NULL::DOUBLE AS delta FROM s
  UNION ALL SELECT spectrum, p, low, high, most, a + (kind IN (1, 3, 5))::INT, b + (kind IN (1, 2, 4))::INT, CASE WHEN kind IN (1, 3) THEN x ELSE la END, CASE WHEN kind IN (1, 2) THEN y ELSE lb END,
   CASE kind WHEN 1 THEN abs(y - x) WHEN 2 THEN abs(y - x1) WHEN 3 THEN abs(y1 - x) END FROM (
   SELECT *, CASE WHEN abs(x - y) <= {R.TOLERANCE}::DOUBLE THEN 1 WHEN abs(la - y) <= {R.TOLERANCE}::DOUBLE THEN 2 WHEN abs(x - lb) <= {R.TOLERANCE}::DOUBLE THEN 3 WHEN x < y THEN 4 ELSE 5 END AS kind FROM (
    SELECT w.*, v[low - a] AS x, 2 * p - v[high + b + 1] AS y, v[low - a + 1] AS x1, 2 * p - v[high + b] AS y1 FROM w JOIN m USING (spectrum) WHERE a < low AND b < most - high))),
 c AS (SELECT spectrum, p, sum(1 - delta) AS score, count(*) AS n_symmetries FROM w WHERE delta IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT spectrum, p, n, coalesce(score, 0) AS score, coalesce(n_symmetries, 0) AS n_symmetries FROM pts LEFT JOIN c USING (spectrum, p)), k AS (SELECT *, max(score) OVER (PARTITION BY spectrum) AS best FROM t)
 SELECT spectrum, {_M.format('p')} AS point_u, n, {_M.format('score')} AS score_u, n_symmetries, (row_number() OVER (PARTITION BY spectrum ORDER BY p) - 1)::INT AS cluster_id FROM k WHERE score > best * 0.75::DOUBLE""")
def event_pivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots of each user's events with the score of the symmetry about them, those above three quarters of the best."""
    aug = R.event_aug(spark, sf_dir)
    points = search.clustered(search.overlap_pivots(aug, R.event_pair_table(spark, sf_dir), R.TOLERANCE, dims.greatest_target(spark, "pair") + R.TOLERANCE))
    kept = symmetry.screened(symmetry.symmetry_scores(aug, points, R.TOLERANCE), 0.75)
    return kept.select("spectrum", S.micro(F.col("point")).alias("point_u"), "n", S.micro(F.col("score")).alias("score_u"), "n_symmetries", "cluster_id")
