"""Annotate, align and enumerate: the stages as lazily evaluated tables keyed by spectrum and cluster."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.params import AMINOS, LOSSES, MODS, SERIES, AlignmentParams, AnnotationParams, EnumerationParams
from ..functions.scalars import combine_symbols, rounded
from ..functions.storage import materialize
from ..operators import candidates as C
from ..operators import labels as L
from ..operators import paths as P
from ..operators import peaks as K
from ..operators import annotation, enumeration, multi, product, search, symmetry, topology
from ..operators.annotation import UPPER

#: Walks of a cluster up to which it is enumerated within a task, and edges of its graphs or of its alignment.
WALKS, EDGES = 50_000, 200_000


@dataclass
class Tables:
    """Every table of an annotation, by joins."""

    peaks: DataFrame
    aug: DataFrame
    pairs: DataFrame
    lower: DataFrame
    quads: DataFrame
    clusters: DataFrame
    paired_peaks: DataFrame
    upper: DataFrame
    labels: DataFrame
    edges: DataFrame
    #: (what, k) to the hits of targets of k > 1 residues: pair, lower or upper.
    multi: dict[tuple[str, int], DataFrame] = field(default_factory=dict)


class Annotation:
    """What is found in spectra (spectrum, peak_id, mz, intensity). An empty table gives empty tables.

    ``nodes`` (spectrum, peak_id, charge, node, n, cost), ``clusters``, ``paired_peaks``, ``noted`` (the edges with what their weight fits) and ``edges`` are made in streams of whole spectra, those of
    spectra of more than ``annotation.PEAKS`` peaks by joins. All other tables (``Tables``) are made by joins when they are first asked for.
    """

    def __init__(self, peaks: DataFrame, params: AnnotationParams) -> None:
        self.params, self.peaks = params, materialize(peaks, "annotate")
        large = annotation.large_spectra(self.peaks)
        self._small, self._large = self.peaks, None
        if not large.isEmpty():
            large = materialize(large, "annotate-large")
            self._small, part = self.peaks.join(large, "spectrum", "left_anti"), self.peaks.join(large, "spectrum", "left_semi")
            self._large = joined(part, params)

    @cached_property
    def tables(self) -> Tables:
        return joined(self.peaks, self.params)

    def __getattr__(self, name: str):
        if name in Tables.__dataclass_fields__:
            return getattr(self.tables, name)
        raise AttributeError(name)

    @cached_property
    def _targets(self) -> DataFrame:
        return dims.all_targets(self.peaks.sparkSession)

    @cached_property
    def nodes(self) -> DataFrame:
        found = annotation.annotated(self._small, self._targets, self.params, nodes=True)
        found = found.select("spectrum", F.col("a").cast(self.peaks.schema["peak_id"].dataType).alias("peak_id"), F.col("b").cast("int").alias("charge"), F.col("c").alias("node"), F.col("d").alias("n"), F.col("x").alias("cost"))
        if self._large is None:
            return found
        each = self._large.labels.groupBy("spectrum", "peak_id", "charge", F.col("node_id").cast("long").alias("node"))
        return found.unionByName(each.agg(F.count("*").alias("n"), F.min("cost").alias("cost")))

    @cached_property
    def _found(self) -> DataFrame:
        return materialize(annotation.annotated(self._small, self._targets, self.params, nodes=False), "annotated")

    def _of(self, *kinds: int) -> DataFrame:
        return self._found.filter(F.col("kind").isin(*kinds))

    @cached_property
    def clusters(self) -> DataFrame:
        found = self._of(annotation.CLUSTER).select("spectrum", "cluster_id", F.col("x").alias("point"), F.col("y").alias("score"))
        return found if self._large is None else found.unionByName(self._large.clusters.select(found.columns))

    @cached_property
    def paired_peaks(self) -> DataFrame:
        found = self._of(annotation.MATES).select("spectrum", "cluster_id", F.col("a").alias("low"), F.col("b").alias("high"))
        return found if self._large is None else found.unionByName(self._large.paired_peaks.select(found.columns))

    @cached_property
    def noted(self) -> DataFrame:
        """(spectrum, cluster_id, side, src, dst, weight, hits)"""
        side = F.element_at(F.array(*map(F.lit, annotation.SIDES)), F.col("kind") - annotation.LOWER + 1)
        found = self._of(annotation.LOWER, annotation.HIGHER, annotation.PIVOT).select("spectrum", "cluster_id", side.alias("side"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("weight"), "hits")
        if self._large is None:
            return found
        return found.unionByName(materialize(product.annotated(self._large.edges, _hits(self._large)), "annotate-noted").withColumn("hits", F.col("hits").cast(f"array<{annotation.HIT}>")))

    @cached_property
    def edges(self) -> DataFrame:
        return self.noted.drop("hits")


def annotate(peaks: DataFrame, params: AnnotationParams = AnnotationParams()) -> Annotation:
    """Annotate spectra (spectrum, peak_id, mz, intensity). An empty table gives empty tables."""
    return Annotation(peaks, params)


def joined(peaks: DataFrame, params: AnnotationParams) -> Tables:
    """All tables by joins on spectra, peaks and clusters: a spectrum may have any number of peaks."""
    spark: SparkSession = peaks.sparkSession
    keep = lambda df: materialize(df, "annotate")
    targets = dims.all_targets(spark)
    of = lambda kind: targets.filter(F.col("kind") == kind).drop("kind", "k")
    tolerance = params.query_tolerance
    by_peak, by_cluster = ["spectrum", "aug_idx"], ["spectrum", "cluster_id"]

    # pairs, lower boundaries and pivots
    peaks = keep(peaks)
    aug = keep(K.augment(peaks, params.charges))
    pair_id = F.col("i").cast("long") * (1 << 31) + F.col("j")
    pairs = keep(search.find_pairs(aug, of("pair"), tolerance).withColumn("pair_id", pair_id))
    lower = keep(search.find_boundaries(aug, of("boundary"), tolerance).withColumn("bnd_id", F.col("aug_idx").cast("long")))
    quads = keep(search.overlap_pivots(aug, pairs, tolerance, dims.greatest_target(spark, "pair") + tolerance))
    points = keep(search.clustered(quads))
    kept = symmetry.screened(symmetry.symmetry_scores(aug, points, params.symmetry_tolerance), params.score_factor)
    clusters = keep(kept.select(*by_cluster, "point", "score"))
    matched = symmetry.symmetries(aug, clusters, params.symmetry_tolerance)  # of the points that stay

    # upper boundaries: peaks reflected about each pivot
    placed = peaks.join(clusters.select(*by_cluster, "point"), "spectrum")
    reflected = K.augment(placed, params.charges, pivot="point", on=tuple(by_cluster))
    bnd_id = UPPER * (F.col("cluster_id").cast("long") + 1) + F.col("aug_idx")
    upper = keep(search.find_boundaries(reflected, of("reflected"), tolerance).withColumn("bnd_id", bnd_id))

    # labels, of the peaks of pairs, boundaries, pivots and symmetries
    originals = aug.select("spectrum", "aug_idx", "peak_id", "charge")
    symmetric = keep(matched.join(clusters, ["spectrum", "point"]))

    def slots(df: DataFrame, *columns: str) -> DataFrame:
        each = df.select(*by_cluster, F.posexplode(F.array(*columns)).alias("slot", "aug_idx"))
        return each.join(originals, by_peak).select(*by_cluster, "slot", "peak_id")

    of_pivot = quads.withColumn("point", rounded(F.col("pivot"), 2)).join(clusters, ["spectrum", "point"])
    quad_peaks, paired_peaks = slots(of_pivot, "i", "j", "i2", "j2"), slots(symmetric, "low_idx", "high_idx")
    labels = keep(L.with_nodes(L.fragments(peaks, pairs, lower, upper, quad_peaks, paired_peaks)))

    # graphs: pairs are edges between nodes, boundaries hang on the source
    node = labels.select("spectrum", "peak_id", "charge", F.col("node_id").cast("long").alias("node")).distinct()

    def with_node(df: DataFrame, side: str) -> DataFrame:
        names = {"peak_id": f"{side}_peak", "charge": f"{side}_charge", "node": f"{side}_node"}
        return df.join(node.withColumnsRenamed(names), ["spectrum", f"{side}_peak", f"{side}_charge"])

    ends = pairs.select("spectrum", "pair_id", "left_peak", "left_charge", "right_peak", "right_charge", "m1", "m2").distinct()
    pair_nodes = with_node(with_node(ends, "left"), "right")
    low = lower.select("spectrum", "bnd_id", "peak_id", "charge", "mass").distinct().join(node, ["spectrum", "peak_id", "charge"])
    back = (2 * F.col("point") - F.col("mass")).alias("mass")
    high = upper.select(*by_cluster, "bnd_id", "peak_id", "charge", back).distinct().join(node, ["spectrum", "peak_id", "charge"])
    edges = keep(topology.spectrum_edges(pair_nodes, low, high, clusters.select(*by_cluster, "point"), tolerance))

    def single(name: str) -> DataFrame:
        """The node at charge 1 of the peak behind an index."""
        at = originals.select("spectrum", F.col("aug_idx").alias(f"{name}_idx"), "peak_id")
        return at.join(node.filter("charge = 1").select("spectrum", "peak_id", F.col("node").alias(name)), ["spectrum", "peak_id"]).drop("peak_id")

    mates = symmetric.join(single("low"), ["spectrum", "low_idx"]).join(single("high"), ["spectrum", "high_idx"])
    mates = keep(mates.select(*by_cluster, "low", "high").distinct())
    several = {}
    for k in range(2, params.max_k + 1):
        least = k * of("pair").agg(F.min("mass")).first()[0]
        gaps = keep(search.peak_pairs(aug, least - tolerance, k * dims.greatest_target(spark, "pair") + tolerance))
        for name, queries, value, kind in (("pair", gaps, "gap", "pair"), ("lower", aug, "mass", "boundary"), ("upper", reflected, "mass", "reflected")):
            several[name, k] = multi.find_multi(queries, value, kind, k, tolerance)
    return Tables(peaks, aug, pairs, lower, quads, clusters, mates, upper, labels, edges, several)


def _hits(a: Tables) -> DataFrame:
    columns = ["cost", "amino_id", "left_loss_id", "right_loss_id", "mod_id", "target"]
    named = lambda df, src, key: df.select("spectrum", F.lit(src).alias("src"), F.col(key).alias("id"), *columns)
    return named(a.pairs, "pair", "pair_id").unionByName(named(a.lower, "boundary", "bnd_id")).unionByName(named(a.upper, "boundary", "bnd_id"))


def align(a: Annotation, params: AlignmentParams = AlignmentParams()) -> DataFrame:
    return product.align_noted(a.noted.filter("side <> 'pivot'"), a.paired_peaks, params)


def _loss_names(reverse: bool) -> Column:
    """Names of the boundary losses, by id: every series with every loss."""
    series = [s for s, _ in SERIES]
    return F.array(*(F.lit(f"{s} {x}".strip()) for s in (reversed(series) if reverse else series) for x, _ in LOSSES))


def _taken(a: Annotation) -> DataFrame:
    """(spectrum, cluster_id, side, src, dst, weight, symbol, mass, cost, right_loss_id): the edges with the cheapest of their hits, ties by features. Its mass is that of the whole target."""
    names, mods = F.array(*(F.lit(s) for s, _ in AMINOS)), F.array(*(F.lit(f"[{s}]" if s else "") for s, _ in MODS))
    best = a.noted.filter(F.size("hits") > 0).withColumn("hit", F.array_min("hits")).drop("hits")
    symbol = F.concat(F.element_at(names, F.col("hit.amino_id") + 1), F.element_at(mods, F.col("hit.mod_id") + 1)).alias("symbol")
    return best.select("spectrum", "cluster_id", "side", "src", "dst", "weight", symbol, F.col("hit.target").alias("mass"), "hit.cost", "hit.right_loss_id")


def _ends(noted: DataFrame) -> Column:
    """1 for an edge from the source that is of series b, 2 for one of y, else 0."""
    name = F.element_at(F.when(F.col("side") == "upper", _loss_names(True)).otherwise(_loss_names(False)), F.col("right_loss_id") + 1)
    has = lambda x: F.array_contains(F.split(name, " "), x)
    return F.when(F.col("src") != topology.SOURCE, 0).when(has("b") & ~has("y"), 1).when(has("y") & ~has("b"), 2).otherwise(0)


def _spelled(walks: DataFrame, noted: DataFrame) -> DataFrame:
    """(spectrum, cluster_id, path_id, step, symbol, mass, losses, rank): the steps of the paths, with the residues of both halves."""
    on = ["spectrum", "cluster_id"]

    def side(name: str, x: str) -> DataFrame:
        columns = [F.col(c).alias(f"{c}_{x}") for c in ("symbol", "mass", "right_loss_id")]
        return noted.filter(F.col("side") == name).select(*on, F.col("dst").alias(f"src_{x}"), F.col("src").alias(f"dst_{x}"), *columns)

    step = P.steps(walks).join(side("lower", "low"), [*on, "src_low", "dst_low"], "left").join(side("upper", "up"), [*on, "src_up", "dst_up"], "left")
    low, up = F.col("symbol_low"), F.col("symbol_up")
    symbol = F.coalesce(combine_symbols(low, up), low, up, F.lit(""))
    loss = lambda reverse, x: F.when(F.col(f"dst_{x}") == topology.SOURCE, F.element_at(_loss_names(reverse), F.col(f"right_loss_id_{x}") + 1))
    losses = F.array_compact(F.array(loss(False, "low"), loss(True, "up")))
    mass = F.coalesce("mass_low", F.lit(0.0)) + F.coalesce("mass_up", F.lit(0.0))
    return step.select(*on, "path_id", "step", symbol.alias("symbol"), mass.alias("mass"), losses.alias("losses"), F.lit(0).alias("rank"))


def _candidates_joined(edges: DataFrame, noted: DataFrame, aligned: DataFrame, params: EnumerationParams, most: int) -> DataFrame:
    """As ``enumeration.cheapest``, by joins: any number of walks of a cluster is dealt to all tasks."""
    on = ["spectrum", "cluster_id"]
    walks = materialize(P.trace(aligned, params.cost_threshold, params.max_paths), "paths")
    spelled = materialize(_spelled(walks, noted), "steps")
    ends = spelled.groupBy(*on, "path_id").agg(F.max_by("losses", "step").alias("symbols"))
    affixes = C.oriented(walks.join(ends, [*on, "path_id"]))
    for half in ("lower", "upper"):  # without the virtual node
        affixes = affixes.withColumn(half, F.slice(half, 2, F.size(half)))
    take = lambda kind, name: affixes.filter(F.col("kind").isin(kind, "infix")).select(*on, F.col("path_id").alias(name), "cost", "lower", "upper")
    paired = C.pair_affixes(take("prefix", "prefix_id"), take("suffix", "suffix_id"), topology.undirected(edges), on)
    at_pivot = noted.filter("side = 'pivot'").dropDuplicates([*on, "weight"])  # edges of one weight are taken for the same
    pivot_hits = at_pivot.select(*on, F.col("weight").alias("pair_id"), "symbol", (2 * F.col("mass")).alias("mass"), "cost")
    named = lambda name: spelled.withColumnRenamed("path_id", name)
    found = C.sequences(paired, named("prefix_id"), named("suffix_id"), pivot_hits, on)
    found = found.groupBy(*on, "sequence").agg(F.min(F.struct("cost", "mass")).alias("least")).select(*on, "sequence", "least.cost", "least.mass")
    return C.top(found, most, on)


def enumerate_candidates(a: Annotation, aligned: DataFrame, params: EnumerationParams = EnumerationParams(), most: int = 5) -> DataFrame:
    """The ``most`` cheapest candidates of each cluster: (spectrum, cluster_id, sequence, cost, mass, offset, rank). Of equal costs of a sequence the least mass is kept."""
    on = ["spectrum", "cluster_id"]
    aligned = materialize(aligned.select(*on, "src_low", "src_up", "dst_low", "dst_up", "cost"), "enumerate-edges")
    noted = _taken(a)
    wide = [df.groupBy(*on).count().filter(F.col("count") > EDGES).select(*on) for df in (aligned, a.edges)]
    wide = materialize(wide[0].unionByName(wide[1]).distinct(), "enumerate-wide")
    some = not wide.isEmpty()
    of = lambda df: df.join(wide, on, "left_anti") if some else df
    ended = of(noted).select(*on, "side", "src", "dst", "weight", "symbol", "mass", "cost", _ends(noted).alias("ends"))
    found = materialize(enumeration.cheapest(of(aligned), ended, params.cost_threshold, most, WALKS, params.max_paths), "candidates")
    if not found.filter(F.col("rank") == enumeration.OVER).isEmpty():
        raise ValueError(f"more than {params.max_paths} paths: lower the cost threshold")
    large = found.filter(F.col("rank") == enumeration.LARGE).select(*on).unionByName(wide)
    found = found.filter("rank >= 0")
    if not large.isEmpty():
        part = lambda df: df.join(large, on, "left_semi")
        found = found.unionByName(_candidates_joined(part(a.edges), part(noted), part(aligned), params, most).select(found.columns))
    pivots = a.clusters.select("spectrum", F.col("cluster_id").alias("pivot_idx"), F.col("point").alias("pivot"))
    return C.best_pivot(found, pivots, ["spectrum"], ["cluster_id", "sequence"]).select(*on, "sequence", "cost", "mass", "offset", "rank")
