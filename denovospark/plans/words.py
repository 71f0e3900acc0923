"""The three stages over the words of the documents, with default parameters, and the SQL that annotation and alignment are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import params as P
from ..functions import scalars as S
from ..operators import multi, peaks, search
from . import pipeline
from . import registry as R
from .registry import query

_TOL = f"{R.TOLERANCE}::DOUBLE"
_FEATURES = "amino_id, left_loss_id, right_loss_id, mod_id"
_ALIGN, _ANNOTATE = P.AlignmentParams(), P.AnnotationParams()


def _near(value: str, target: str = "t.mass") -> str:
    return f"{target} >= {value} - {_TOL} AND {target} <= {value} + {_TOL}"


#: Tables of the annotation: peaks, masses, pairs, boundaries, pivots, symmetries, nodes, edges, symmetric nodes and annotations.
_ANNOTATION = f"""WITH RECURSIVE pk AS MATERIALIZED (SELECT peptide AS spectrum, row_number() OVER (PARTITION BY peptide ORDER BY mz, series)::INT - 1 AS peak_id, mz FROM {R._IONS}),
 cs AS (SELECT unnest({list(_ANNOTATE.charges)}) AS c), tp AS MATERIALIZED {R._targets('pair')}, tb AS MATERIALIZED {R._targets('boundary')}, tr AS MATERIALIZED {R._targets('reflected')},
 aug AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY spectrum ORDER BY mass, charge, peak_id)::INT - 1 AS aug_idx FROM (
  SELECT spectrum, peak_id, c AS charge, c * mz - {P.HYDROGEN}::DOUBLE * (c - 1) AS mass FROM pk, cs) WHERE mass > 0),
 gaps AS MATERIALIZED (SELECT a.spectrum, a.aug_idx AS i, b.aug_idx AS j, a.peak_id AS left_peak, b.peak_id AS right_peak, a.charge AS left_charge, b.charge AS right_charge, a.mass AS m1, b.mass AS m2, b.mass - a.mass AS gap
  FROM aug a JOIN aug b ON a.spectrum = b.spectrum AND a.aug_idx < b.aug_idx),
 pairs AS MATERIALIZED (SELECT g.*, i::BIGINT * 2147483648 + j AS pair_id, {_FEATURES}, abs(gap - t.mass) * (1 + complexity) AS cost FROM (SELECT * FROM gaps WHERE left_peak <> right_peak) g JOIN tp t ON {_near('gap')}),
 lower AS MATERIALIZED (SELECT a.*, aug_idx::BIGINT AS bnd_id, {_FEATURES}, abs(a.mass - t.mass) * (1 + complexity) AS cost FROM aug a JOIN tb t ON {_near('a.mass')}),
 ends AS (SELECT DISTINCT spectrum, i, j AS i2, m1, m2, gap, unnest([floor(gap * 20) - 1, floor(gap * 20), floor(gap * 20) + 1]) AS bucket FROM pairs),
 quads AS MATERIALIZED (SELECT p.spectrum, p.i, g.i AS j, p.i2, g.j AS j2, round_even((p.m1 + g.m1 + p.m2 + g.m2) / 4 * 100.0::DOUBLE, 0) / 100.0 AS p FROM ends p JOIN gaps g
  ON g.spectrum = p.spectrum AND floor(g.gap * 20) = p.bucket AND abs(p.gap - g.gap) < {_TOL} AND p.i < g.i AND g.i < p.i2 AND p.i2 < g.j),
 pts AS MATERIALIZED (SELECT spectrum, p FROM quads GROUP BY ALL), m AS MATERIALIZED (SELECT spectrum, list(mass ORDER BY aug_idx) AS v FROM aug GROUP BY 1),
 w AS (SELECT spectrum, p, len([x FOR x IN v IF x < p]) AS low, len([x FOR x IN v IF x <= p]) AS high, len(v) AS most, 0::BIGINT AS a, 0::BIGINT AS b, 'infinity'::DOUBLE AS la, 'infinity'::DOUBLE AS lb,
   NULL::DOUBLE AS delta, 0::BIGINT AS low_idx, 0::BIGINT AS high_idx FROM pts JOIN m USING (spectrum)
  UNION ALL SELECT spectrum, p, low, high, most, a + (kind IN (1, 3, 5))::INT, b + (kind IN (1, 2, 4))::INT, CASE WHEN kind IN (1, 3) THEN x ELSE la END, CASE WHEN kind IN (1, 2) THEN y ELSE lb END,
   CASE kind WHEN 1 THEN abs(y - x) WHEN 2 THEN abs(y - x1) WHEN 3 THEN abs(y1 - x) END, low - 1 - a + (kind = 2)::INT, high + b - (kind = 3)::INT FROM (
   SELECT *, CASE WHEN abs(x - y) <= {_TOL} THEN 1 WHEN abs(la - y) <= {_TOL} THEN 2 WHEN abs(x - lb) <= {_TOL} THEN 3 WHEN x < y THEN 4 ELSE 5 END AS kind FROM (
    SELECT w.*, v[low - a] AS x, 2 * p - v[high + b + 1] AS y, v[low - a + 1] AS x1, 2 * p - v[high + b] AS y1 FROM w JOIN m USING (spectrum) WHERE a < low AND b < most - high))),
 sym AS MATERIALIZED (SELECT spectrum, p, low_idx, high_idx, delta FROM w WHERE delta IS NOT NULL),
 sc AS (SELECT spectrum, p, coalesce(sum(1 - delta), 0) AS score FROM pts LEFT JOIN sym USING (spectrum, p) GROUP BY 1, 2),
 cl AS MATERIALIZED (SELECT spectrum, p, row_number() OVER (PARTITION BY spectrum ORDER BY p)::INT - 1 AS cluster_id FROM (SELECT *, max(score) OVER (PARTITION BY spectrum) AS best FROM sc) WHERE score > best * {_ANNOTATE.score_factor}::DOUBLE),
 upper AS MATERIALIZED (SELECT r.*, 1000000000::BIGINT * (cluster_id + 1) + aug_idx AS bnd_id, {_FEATURES}, abs(r.mass - t.mass) * (1 + complexity) AS cost FROM (
   SELECT *, row_number() OVER (PARTITION BY spectrum, cluster_id ORDER BY mass, charge, peak_id)::INT - 1 AS aug_idx FROM (
    SELECT spectrum, cluster_id, p, peak_id, c AS charge, 2 * p - (c * mz - {P.HYDROGEN}::DOUBLE * (c - 1)) AS mass FROM pk JOIN cl USING (spectrum), cs) WHERE mass > 0) r JOIN tr t ON {_near('r.mass')}),
 kq AS (SELECT q.spectrum, cluster_id, unnest([q.i, q.j, q.i2, q.j2]) AS aug_idx FROM quads q JOIN cl USING (spectrum, p)),
 ks AS MATERIALIZED (SELECT s.*, cluster_id FROM sym s JOIN cl USING (spectrum, p)),
 lab AS MATERIALIZED (SELECT spectrum, left_peak AS peak_id, left_charge AS charge, cost FROM pairs UNION ALL SELECT spectrum, right_peak, right_charge, cost FROM pairs UNION ALL SELECT spectrum, peak_id, charge, cost FROM lower
  UNION ALL SELECT spectrum, peak_id, charge, cost FROM upper UNION ALL SELECT spectrum, peak_id, 1, NULL FROM kq JOIN aug USING (spectrum, aug_idx)
  UNION ALL SELECT k.spectrum, peak_id, 1, NULL FROM (SELECT spectrum, unnest([low_idx, high_idx]) AS aug_idx FROM ks) k JOIN aug USING (spectrum, aug_idx)),
 node AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY spectrum ORDER BY trunc(mz * charge / 0.01::DOUBLE)::BIGINT) - 1 AS node FROM (SELECT spectrum, peak_id, charge, min(cost) AS cost, count(*) AS n FROM lab GROUP BY 1, 2, 3) JOIN pk USING (spectrum, peak_id))"""
_GRAPH = f"""{_ANNOTATION},
 pn AS (SELECT DISTINCT a.spectrum, pair_id, l.node AS l, r.node AS r, m1, m2 FROM pairs a JOIN node l ON l.spectrum = a.spectrum AND l.peak_id = left_peak AND l.charge = left_charge
  JOIN node r ON r.spectrum = a.spectrum AND r.peak_id = right_peak AND r.charge = right_charge),
 e AS MATERIALIZED (SELECT spectrum, cluster_id, CASE WHEN m2 < p THEN 'lower' WHEN m1 > p AND m2 < 2 * (p + {_TOL}) THEN 'upper' ELSE 'pivot' END AS side, l, r, pair_id FROM pn JOIN cl USING (spectrum)),
 edges AS MATERIALIZED (SELECT spectrum, cluster_id, side, src, dst, max(weight) AS weight FROM (
  SELECT spectrum, cluster_id, side, CASE WHEN side = 'upper' THEN r ELSE l END AS src, CASE WHEN side = 'upper' THEN l ELSE r END AS dst, pair_id AS weight FROM e
  UNION ALL SELECT spectrum, cluster_id, 'lower', l, -2, -1 FROM e WHERE side = 'pivot' UNION ALL SELECT spectrum, cluster_id, 'upper', r, -2, -1 FROM e WHERE side = 'pivot'
  UNION ALL SELECT b.spectrum, cluster_id, 'lower', -1, node, bnd_id FROM lower b JOIN node USING (spectrum, peak_id, charge) JOIN cl ON cl.spectrum = b.spectrum AND b.mass < p
  UNION ALL SELECT b.spectrum, cluster_id, 'upper', -1, node, bnd_id FROM upper b JOIN node USING (spectrum, peak_id, charge) WHERE 2 * p - b.mass > p AND 2 * p - b.mass < 2 * (p + {_TOL})) WHERE side <> 'pivot' GROUP BY ALL),
 one AS (SELECT spectrum, aug_idx, node FROM aug JOIN (SELECT spectrum, peak_id, node FROM node WHERE charge = 1) USING (spectrum, peak_id)),
 mates AS MATERIALIZED (SELECT DISTINCT k.spectrum, cluster_id, l.node AS low, h.node AS up, true AS same FROM ks k JOIN one l ON l.spectrum = k.spectrum AND l.aug_idx = low_idx JOIN one h ON h.spectrum = k.spectrum AND h.aug_idx = high_idx
  UNION SELECT spectrum, cluster_id, unnest([-1, -2]), unnest([-1, -2]), true FROM cl),
 notes AS (SELECT spectrum, kind, weight, list({{'c': cost, 'a': amino_id, 'l': left_loss_id, 'r': right_loss_id, 'm': mod_id}}) AS hits FROM (SELECT spectrum, 'pair' AS kind, pair_id AS weight, cost, {_FEATURES} FROM pairs
  UNION ALL SELECT spectrum, 'boundary', bnd_id, cost, {_FEATURES} FROM lower UNION ALL SELECT spectrum, 'boundary', bnd_id, cost, {_FEATURES} FROM upper) GROUP BY 1, 2, 3),
 noted AS MATERIALIZED (SELECT edges.spectrum, cluster_id, side, src, dst, coalesce(hits, []) AS hits, coalesce(list_min([x.c FOR x IN hits]), 0) + {_ALIGN.edge_gap}::DOUBLE AS alone
  FROM edges LEFT JOIN notes ON notes.spectrum = edges.spectrum AND notes.weight = edges.weight AND kind = CASE WHEN src < 0 THEN 'boundary' ELSE 'pair' END),
 lo AS MATERIALIZED (SELECT spectrum, cluster_id, src AS low, dst AS low_to, hits AS lh, alone AS la FROM noted WHERE side = 'lower' UNION ALL SELECT DISTINCT spectrum, cluster_id, n, n, NULL, NULL FROM (SELECT spectrum, cluster_id, unnest([src, dst, -1]) AS n FROM noted WHERE side = 'lower' UNION SELECT spectrum, cluster_id, -1 FROM noted)),
 hi AS MATERIALIZED (SELECT spectrum, cluster_id, src AS up, dst AS up_to, hits AS uh, alone AS ua FROM noted WHERE side = 'upper' UNION ALL SELECT DISTINCT spectrum, cluster_id, n, n, NULL, NULL FROM (SELECT spectrum, cluster_id, unnest([src, dst, -1]) AS n FROM noted WHERE side = 'upper' UNION SELECT spectrum, cluster_id, -1 FROM noted))"""


def _differ(x: str, y: str) -> str:
    return " + ".join(f"({x}.{f} <> {y}.{f})::INT" for f in "alrm")


_ALONG = f"""CASE WHEN lh IS NULL THEN ua WHEN uh IS NULL THEN la WHEN low_to = -2 AND up_to = -2 THEN 0 WHEN len(lh) = 0 THEN ua WHEN len(uh) = 0 THEN la
  ELSE list_min(flatten(list_transform(lh, lambda x: list_transform(uh, lambda y: x.c + y.c + ({_differ('x', 'y')}))))) END"""
_ALIGNED = f"""{_GRAPH},
 d(spectrum, cluster_id, low, up, dist) USING KEY (spectrum, cluster_id, low, up) AS (SELECT DISTINCT spectrum, cluster_id, -1::BIGINT, -1::BIGINT, 0::DOUBLE FROM noted
  UNION SELECT s.spectrum, s.cluster_id, s.low, s.up, s.dist FROM (SELECT spectrum, cluster_id, low, up, before + CASE WHEN same THEN {_ALIGN.node_match}::DOUBLE ELSE {_ALIGN.node_mismatch}::DOUBLE END AS dist FROM (
    SELECT d.spectrum, d.cluster_id, low_to AS low, up_to AS up, min(dist + {_ALONG}) AS before FROM d JOIN lo USING (spectrum, cluster_id, low) JOIN hi USING (spectrum, cluster_id, up) WHERE lh IS NOT NULL OR uh IS NOT NULL GROUP BY 1, 2, 3, 4)
   LEFT JOIN mates USING (spectrum, cluster_id, low, up)) s LEFT JOIN recurring.d AS k ON k.spectrum = s.spectrum AND k.cluster_id = s.cluster_id AND k.low = s.low AND k.up = s.up
  WHERE s.dist <= {_ALIGN.cost_threshold}::DOUBLE AND (k.dist IS NULL OR s.dist < k.dist))
 SELECT x.spectrum, x.cluster_id, src_low, src_up, x.low AS dst_low, x.up AS dst_up, {R._MICRO.format('along')} AS cost_u, {R._MICRO.format('dist')} AS dist_u FROM (
  SELECT d.spectrum, d.cluster_id, low AS src_low, up AS src_up, low_to AS low, up_to AS up, dist, {_ALONG} AS along FROM d JOIN lo USING (spectrum, cluster_id, low) JOIN hi USING (spectrum, cluster_id, up) WHERE lh IS NOT NULL OR uh IS NOT NULL) x
 LEFT JOIN mates USING (spectrum, cluster_id, low, up) WHERE dist + along + CASE WHEN same THEN {_ALIGN.node_match}::DOUBLE ELSE {_ALIGN.node_mismatch}::DOUBLE END <= {_ALIGN.cost_threshold}::DOUBLE"""


def word_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ions of each word as an unlabelled spectrum."""
    order = W.partitionBy("peptide").orderBy("mz", "series")
    ions = R.word_ion_table(spark, sf_dir)
    return ions.select(F.col("peptide").alias("spectrum"), (F.row_number().over(order) - 1).alias("peak_id"), "mz", F.lit(1.0).alias("intensity"))


@query(f"{_ANNOTATION} SELECT spectrum, peak_id, charge, node, {R._MICRO.format('cost')} AS cost_u, n FROM node")
def annotated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation of all words: for each labelled peak and charge its node, its labels and the cost of the cheapest."""
    cost = F.when(F.col("cost") < float("inf"), F.col("cost"))
    return pipeline.annotate(word_peaks(spark, sf_dir)).nodes.select("spectrum", "peak_id", "charge", "node", S.micro(cost).alias("cost_u"), "n")


@query(_ALIGNED)
def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of the halves of all words."""
    aligned = pipeline.align(pipeline.annotate(word_peaks(spark, sf_dir)))
    return aligned.select("spectrum", "cluster_id", "src_low", "src_up", "dst_low", "dst_up", S.micro(F.col("cost")).alias("cost_u"), S.micro(F.col("dist")).alias("dist_u"))


#: Walks grow with every unit of cost: the 3,295 words of the smallest tables have some 7 million under 8, 1 million under 4, and about 300,000 under 2.
CANDIDATE_COST = 2.0


@query()
def word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cheapest candidates of all words, of walks that cost less than CANDIDATE_COST."""
    a = pipeline.annotate(word_peaks(spark, sf_dir))
    return pipeline.enumerate_candidates(a, pipeline.align(a), P.EnumerationParams(cost_threshold=CANDIDATE_COST))


@query(f"""WITH s AS {R._SPECTRA}, t AS MATERIALIZED (SELECT p.mass + b.mass AS mass, b.amino_id AS first, p.amino_id AS second,
  (p.left_loss_id <> 0)::INT + (b.right_loss_id % 5 <> 0 OR p.right_loss_id <> 0)::INT + (b.mod_id <> 0 OR p.mod_id <> 0)::INT AS complexity FROM {R._targets('boundary')} b, {R._targets('pair')} p)
 SELECT spectrum, aug_idx, first, second, count(*) AS n, sum({R._MICRO.format('(abs(s.mass - t.mass) * (1 + complexity))')})::BIGINT AS cost_u FROM s JOIN t ON {_near('s.mass')} GROUP BY 1, 2, 3, 4""")
def word_multi_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of two residues in the words' spectra, by the residues."""
    found = multi.find_multi(R.word_spectra(spark, sf_dir).select("spectrum", "aug_idx", "mass"), "mass", "boundary", 2, R.TOLERANCE)
    pair = found.groupBy("spectrum", "aug_idx", F.get("amino_ids", F.lit(0)).alias("first"), F.get("amino_ids", F.lit(1)).alias("second"))
    return pair.agg(F.count("*").alias("n"), F.sum(S.micro(F.col("cost"))).alias("cost_u"))


_DESCRIBED = f"JOIN {R._AMINOS} a USING (amino_id) JOIN {R._boundary_losses(False)} r ON r.loss_id = t.right_loss_id JOIN {R._MODS} m USING (mod_id)"


@query(f"""SELECT a.amino, r.loss AS right_loss, m.mod, count(*) AS n, count(DISTINCT spectrum) AS n_spectra, sum({R._MICRO.format('(a.mass - r.mass + m.mass)')})::BIGINT AS mass_u
 FROM {R._SPECTRA} s JOIN {R._targets('boundary')} t ON {_near('s.mass')} {_DESCRIBED} GROUP BY 1, 2, 3""")
def word_boundary_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the boundary hits of the words stand for: residue, series with loss, and modification."""
    hits = search.find_boundaries(R.word_spectra(spark, sf_dir), dims.targets(spark, "boundary").drop("kind", "k"), R.TOLERANCE)
    mass = F.col("amino_mass") + F.col("left_loss_mass") - F.col("right_loss_mass") + F.col("mod_mass")
    said = dims.described(spark, hits, "boundary").groupBy("amino", "right_loss", "mod")
    return said.agg(F.count("*").alias("n"), F.countDistinct("spectrum").alias("n_spectra"), F.sum(S.micro(mass)).alias("mass_u"))


@query(f"""WITH ok AS {R._values([(a, x) for a in range(len(P.AMINOS)) for x in [0, *P.LOSSES_OF.get(a, [])]], "amino_id, loss")}
 SELECT s.spectrum, count(*) AS n_hits, count(DISTINCT aug_idx) AS n_peaks, sum({R._MICRO.format('(abs(s.mass - t.mass) * (1 + complexity))')})::BIGINT AS cost_u
 FROM {R._SPECTRA} s JOIN {R._targets('boundary')} t ON {_near('s.mass')} JOIN ok ON ok.amino_id = t.amino_id AND ok.loss = t.right_loss_id % 5 GROUP BY 1""")
def word_applicable_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary hits of the words whose loss applies to the residue."""
    targets = dims.targets(spark, "boundary", conditional_losses=True).drop("kind", "k")
    hits = search.find_boundaries(R.word_spectra(spark, sf_dir), targets, R.TOLERANCE)
    return hits.groupBy("spectrum").agg(F.count("*").alias("n_hits"), F.countDistinct("aug_idx").alias("n_peaks"), F.sum(S.micro(F.col("cost"))).alias("cost_u"))


@query(f"""WITH t AS (SELECT mass, row_number() OVER (ORDER BY mass, amino_id, left_loss_id, right_loss_id, mod_id) - 1 AS id FROM {R._targets('pair')}),
 c AS (SELECT trunc(mass / 0.01::DOUBLE)::BIGINT AS bucket, min(id)::INT AS first, max(id)::INT AS last FROM t GROUP BY 1)
 SELECT spectrum, bucket, any_value(first) AS first, any_value(last) AS last, count(*) AS n FROM (
  SELECT spectrum, trunc((lead(mass) OVER (PARTITION BY spectrum ORDER BY aug_idx) - mass) / 0.01::DOUBLE)::BIGINT AS bucket FROM {R._SPECTRA}) g JOIN c USING (bucket) GROUP BY 1, 2""")
def word_target_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbouring masses of the words by the cluster of pair targets that they fall in, with the cluster's span of targets."""
    order = W.partitionBy("spectrum").orderBy("aug_idx")
    gaps = R.word_spectra(spark, sf_dir).select("spectrum", ((F.lead("mass").over(order) - F.col("mass")) / F.lit(0.01)).cast("long").alias("bucket"))
    clusters = dims.target_clusters(dims.ranked_targets(dims.targets(spark, "pair")), 0.01).select("bucket", "first", "last")  # some hundred rows
    return gaps.join(F.broadcast(clusters), "bucket").groupBy("spectrum", "bucket").agg(F.any_value("first").alias("first"), F.any_value("last").alias("last"), F.count("*").alias("n"))
