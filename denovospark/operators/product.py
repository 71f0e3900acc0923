"""Alignment of two spectrum graphs: least costs over their sparse product.

Clusters of up to SMALL edges are aligned whole, those of some batches at once, in sorted streams: one shuffle of their edges, and their products never leave the task. Larger ones, and those
with costs of the user's, are aligned by joins until nothing changes. There the product is never built: a round joins the nodes whose cost has changed with the edges of both graphs, takes the least cost of each node
that they lead to, and keeps what is less than what was known. Keys are the nodes themselves, so one large cluster is dealt to all tasks.
Costs are column expressions, and can be given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.params import AlignmentParams
from ..functions.storage import discard, materialize
from . import streams
from .topology import SINK, SOURCE

KEY = ["spectrum", "cluster_id"]
FEATURES = ["amino_id", "left_loss_id", "right_loss_id", "mod_id"]
#: Edges of a cluster up to which it is aligned within a task: a product of 250,000 pairs of edges at most.
SMALL = 1000
#: From (the annotations of a lower edge, those of an upper edge) to the cost of taking both: never negative.
PairCost = Callable[[Column, Column], Column]
#: From (lower node, upper node, whether they are symmetric) to the cost of a product node: never negative.
NodeCost = Callable[[Column, Column, Column], Column]


def alone_cost(hits: Column, p: AlignmentParams) -> Column:
    """An edge that is taken in one graph alone: its cheapest annotation and the gap's cost."""
    return F.coalesce(F.array_min(F.transform(hits, lambda x: x["cost"])), F.lit(0.0)) + F.lit(p.edge_gap)


def pair_cost(lower: Column, upper: Column, p: AlignmentParams) -> Column:
    """The cheapest combination of two annotations: their costs, and the cost of each feature that differs. An empty side is a gap."""
    differ = lambda x, y: sum((F.when(x[f] == y[f], F.lit(p.edge_match)).otherwise(F.lit(p.edge_mismatch)) for f in FEATURES), F.lit(0.0))
    each = F.flatten(F.transform(lower, lambda x: F.transform(upper, lambda y: x["cost"] + y["cost"] + differ(x, y))))
    return F.when(F.size(lower) == 0, alone_cost(upper, p)).when(F.size(upper) == 0, alone_cost(lower, p)).otherwise(F.array_min(each))


def node_cost(symmetric: Column, p: AlignmentParams) -> Column:
    return F.when(symmetric, F.lit(p.node_match)).otherwise(F.lit(p.node_mismatch))


def annotated(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Edges with the array of their annotations: as many as targets fit a mass, so bounded by the target tables."""
    rest = [c for c in hits.columns if c not in ("spectrum", "src", "id", "cost", *FEATURES)]
    notes = hits.groupBy("spectrum", F.col("src").alias("kind"), F.col("id").alias("weight")).agg(F.collect_list(F.struct("cost", *FEATURES, *rest)).alias("hits"))
    kind = F.when(F.col("src") < 0, "boundary").otherwise("pair")
    none = F.array().cast(dict(notes.dtypes)["hits"])
    return edges.withColumn("kind", kind).join(notes, ["spectrum", "kind", "weight"], "left").select(*KEY, "side", "src", "dst", "weight", F.coalesce("hits", none).alias("hits"))


def neighbours(nodes: DataFrame, lower: DataFrame, upper: DataFrame, alone: Callable[[Column], Column], both: PairCost) -> DataFrame:
    """Steps of the strong product: along either graph, or both at once; ``nodes`` with low_to, up_to and the cost ``along``.

    nodes: KEY, low, up. lower: KEY, low, low_to, low_hits. upper likewise. Where both halves end at the pivot in one step, it costs nothing.
    """
    down = nodes.join(lower, [*KEY, "low"])
    stay = nodes.withColumn("low_to", F.col("low")).withColumn("low_hits", F.lit(None).cast(dict(lower.dtypes)["low_hits"]))
    met = down.unionByName(stay).join(upper, [*KEY, "up"])
    cost = F.when(F.col("low_hits").isNull(), alone(F.col("up_hits"))).when((F.col("low_to") == SINK) & (F.col("up_to") == SINK), F.lit(0.0)).otherwise(both(F.col("low_hits"), F.col("up_hits")))
    columns = [*nodes.columns, "low_to", "up_to", "along"]
    return met.withColumn("along", cost).select(*columns).unionByName(down.withColumn("up_to", F.col("up")).withColumn("along", alone(F.col("low_hits"))).select(*columns))


def least_costs(start: DataFrame, onward: Callable[[DataFrame], DataFrame], node: list[str], name: str) -> DataFrame:
    """(node, dist): the least cost of every node that can be reached from ``start`` (node, dist), by semi-naive iteration.

    ``onward`` takes changed nodes to the (node, dist) that they lead to, those beyond any limit left out. It ends as costs aren't negative.
    """
    known = changed = materialize(start.select(*node, "dist"), name)
    while True:
        found = onward(changed).groupBy(*node).agg(F.min("dist").alias("dist"))
        before = known.select(*node, F.col("dist").alias("_before"))
        better = found.join(before, node, "left").filter(F.col("_before").isNull() | (F.col("dist") < F.col("_before"))).select(*node, "dist")
        now = materialize(better, name)
        if now.isEmpty():
            discard(now)
            return known
        wider = materialize(known.join(now, node, "left_anti").unionByName(now), name)
        discard(*({id(t): t for t in (known, changed)}.values()))
        known, changed = wider, now


#: The features of an annotation as four lanes of a whole number.
LANE = 16
_LOW, _TOP = np.uint64(0x7FFF7FFF7FFF7FFF), np.uint64(0x8000800080008000)


def _packed(features: list[np.ndarray]) -> np.ndarray:
    """Numbers whose lanes are equal where the features are."""
    out = np.zeros(len(features[0]), np.uint64)
    for k, x in enumerate(features):
        if x.min(initial=0) < 0 or x.max(initial=0) >= 1 << LANE:
            x = np.unique(x, return_inverse=True)[1]
            if x.max(initial=0) >= 1 << LANE:
                raise ValueError(f"more than {1 << LANE} ids of {FEATURES[k]}")
        out |= x.astype(np.uint64) << np.uint64(LANE * k)
    return out


class _Side:
    """The edges of one side of some clusters, by source, and their nodes; a node's number is its place among all clusters'."""

    def __init__(self, cluster: np.ndarray, src: np.ndarray, dst: np.ndarray, first: np.ndarray, count: np.ndarray, hits: tuple[np.ndarray, np.ndarray], n: int, p: AlignmentParams) -> None:
        """first, count: each edge's annotations among ``hits`` (costs, packed features). Every cluster has the source."""
        every = np.concatenate([np.full(n, SOURCE), src, dst])
        own = np.concatenate([np.arange(n), cluster, cluster])
        values, at = np.unique(every, return_inverse=True)
        self.values = values
        keys, at = np.unique(own * len(values) + at, return_inverse=True)
        self.keys, self.own, self.value = keys, keys // len(values), values[keys % len(values)]
        self.size = np.bincount(self.own, minlength=n)
        self.base = np.cumsum(self.size) - self.size
        order = np.argsort(at[n : n + len(src)], kind="stable")
        self.src, self.dst = at[n : n + len(src)][order], at[n + len(src) :][order]
        self.begin = np.searchsorted(self.src, np.arange(len(keys) + 1))
        self.first, self.count, (self.cost, self.said) = first[order], count[order], hits
        self.alone = np.zeros(len(src))
        full = np.flatnonzero(self.count)
        _, k = streams.spread(self.first[full], self.count[full])
        if len(full):
            self.alone[full] = np.minimum.reduceat(self.cost[k], np.cumsum(self.count[full]) - self.count[full])
        self.alone += p.edge_gap

    def find(self, cluster: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Numbers of nodes, -1 for those that there aren't."""
        at = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        key = cluster * len(self.values) + at
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.values[at] == value) & (self.keys[place] == key), place, -1)


def _pair_costs(lower: _Side, upper: _Side, one: np.ndarray, two: np.ndarray, p: AlignmentParams) -> np.ndarray:
    """``pair_cost`` of lower and upper edges, and nothing where both end at the pivot."""
    out = np.where(lower.count[one] == 0, upper.alone[two], lower.alone[one])
    met = (lower.value[lower.dst[one]] == SINK) & (upper.value[upper.dst[two]] == SINK)
    out[met] = 0.0
    full = np.flatnonzero((lower.count[one] > 0) & (upper.count[two] > 0) & ~met)
    one, two = one[full], two[full]
    n = upper.count[two]
    cost = np.array([p.edge_match * (len(FEATURES) - k) + p.edge_mismatch * k for k in range(len(FEATURES) + 1)])
    for part in streams.blocks(lower.count[one] * n):
        sizes = lower.count[one[part]] * n[part]
        at, k = streams.spread(np.zeros(len(sizes), np.int64), sizes)
        x, y = lower.first[one[part]][at] + k // n[part][at], upper.first[two[part]][at] + k % n[part][at]
        lanes = lower.said[x] ^ upper.said[y]
        differ = np.bitwise_count((((lanes & _LOW) + _LOW) | lanes) & _TOP)  # the number of lanes that aren't zero
        out[full[part]] = np.minimum.reduceat(lower.cost[x] + upper.cost[y] + cost[differ], np.cumsum(sizes) - sizes)
    return out


def align_clusters(n: int, lower: _Side, upper: _Side, mates: tuple[np.ndarray, ...], p: AlignmentParams) -> tuple[np.ndarray, ...]:
    """(cluster, src_low, src_up, dst_low, dst_up, cost, dist) of ``n`` clusters at once. mates: cluster, low, up.

    A node of the product is opened, which makes its steps, when it is first reached; costs are relaxed from the nodes that have changed.
    """
    base = np.cumsum(lower.size * upper.size) - lower.size * upper.size
    total = int(np.sum(lower.size * upper.size))
    number = lambda c, low, up: base[c] + (low - lower.base[c]) * upper.size[c] + up - upper.base[c]
    every = np.arange(n)
    node = np.full(total, p.node_mismatch)
    for c, low, up in (mates, *((every, np.full(n, x), np.full(n, x)) for x in (SOURCE, SINK))):
        low, up = lower.find(c, low), upper.find(c, up)
        found = (low >= 0) & (up >= 0)
        node[number(c[found], low[found], up[found])] = p.node_match
    dist = np.full(total, np.inf)
    source = np.full(n, SOURCE)
    changed = np.sort(number(every, lower.find(every, source), upper.find(every, source)))
    dist[changed] = 0.0

    def steps(at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The steps from some nodes that may keep to the limit, by node: from, to and cost."""
        c = np.searchsorted(base, at, "right") - 1
        low, up = lower.base[c] + (at - base[c]) // upper.size[c], upper.base[c] + (at - base[c]) % upper.size[c]
        n1, n2 = lower.begin[low + 1] - lower.begin[low], upper.begin[up + 1] - upper.begin[up]
        k, e = streams.spread(np.zeros(len(at), np.int64), n1 * n2)
        one, two = lower.begin[low[k]] + e // n2[k], upper.begin[up[k]] + e % n2[k]
        k1, e1 = streams.spread(lower.begin[low], n1)
        k2, e2 = streams.spread(upper.begin[up], n2)
        src = np.concatenate([k, k1, k2])
        to_low, to_up = np.concatenate([lower.dst[one], lower.dst[e1], low[k2]]), np.concatenate([upper.dst[two], up[k1], upper.dst[e2]])
        along = np.concatenate([_pair_costs(lower, upper, one, two, p), lower.alone[e1], upper.alone[e2]])
        dst = number(c[src], to_low, to_up)
        fits = np.flatnonzero(along + node[dst] <= p.cost_threshold)
        fits = fits[np.argsort(src[fits], kind="stable")]
        return at[src[fits]], dst[fits], along[fits]

    opened = np.zeros(total, bool)
    first, count = np.zeros(total, np.int64), np.zeros(total, np.int64)
    src, dst, along = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    while len(changed):
        new = changed[~opened[changed]]
        if len(new):
            found = steps(new)
            count[new] = np.searchsorted(found[0], new, "right") - np.searchsorted(found[0], new)
            first[new] = len(src) + np.searchsorted(found[0], new)
            src, dst, along = (np.concatenate(x) for x in zip((src, dst, along), found, strict=True))
            opened[new] = True
        _, k = streams.spread(first[changed], count[changed])
        sums = dist[src[k]] + along[k] + node[dst[k]]
        better = (sums <= p.cost_threshold) & (sums < dist[dst[k]])
        k, sums = k[better], sums[better]
        np.minimum.at(dist, dst[k], sums)
        changed = np.unique(dst[k])
    kept = np.flatnonzero(dist[src] + along + node[dst] <= p.cost_threshold)
    src, dst = src[kept], dst[kept]
    order = np.argsort(src, kind="stable")
    src, dst, kept = src[order], dst[order], kept[order]
    c = np.searchsorted(base, src, "right") - 1
    names = [x for at in (src, dst) for x in (lower.value[lower.base[c] + (at - base[c]) // upper.size[c]], upper.value[upper.base[c] + (at - base[c]) % upper.size[c]])]
    return c, *names, along[kept], dist[src]


def _align_streamed(noted: DataFrame, mates: DataFrame, p: AlignmentParams) -> DataFrame:
    hits = noted.schema["hits"].dataType
    edges = noted.select(*KEY, F.when(F.col("side") == "lower", 0).otherwise(1).alias("_kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "hits")
    rows = edges.unionByName(mates.select(*KEY, F.lit(2).alias("_kind"), F.col("low").alias("a"), F.col("up").alias("b"), F.lit(None).cast(hits).alias("hits")))
    schema = StructType([noted.schema[c] for c in KEY])
    for c in ("src_low", "src_up", "dst_low", "dst_up"):
        schema = schema.add(c, "long")
    schema = schema.add("cost", "double").add("dist", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cluster in streams.whole_segments(batches, KEY):
            kind, a, b = (table.column(c).to_numpy() for c in ("_kind", "a", "b"))
            lists = table.column("hits").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            count = lists.value_lengths().fill_null(0).to_numpy()
            values = lists.flatten()
            cost, *said = (values.field(values.type.get_field_index(f)).to_numpy(zero_copy_only=False) for f in ("cost", *FEATURES))
            first = np.cumsum(count) - count
            said = _packed(said)
            named = np.unique(cluster[kind < 2])  # others have mates alone
            if not len(named):
                continue
            own = np.searchsorted(named, cluster)
            sides = [_Side(own[x], a[x], b[x], first[x], count[x], (cost, said), len(named), p) for x in (np.flatnonzero(kind == side) for side in (0, 1))]
            x = np.flatnonzero((kind == 2) & np.isin(cluster, named))
            found = align_clusters(len(named), *sides, (own[x], a[x], b[x]), p)
            held = table.select(KEY).take(pa.array(np.searchsorted(cluster, named[found[0]])))
            yield from pa.Table.from_arrays([*held.columns, *map(pa.array, found[1:])], names=schema.names).combine_chunks().to_batches()

    return streams.in_segments(rows, KEY, ["_kind", "a", "b"]).mapInArrow(run, schema)


def align(edges: DataFrame, hits: DataFrame, symmetric: DataFrame, params: AlignmentParams, both: PairCost | None = None, of_node: NodeCost | None = None) -> DataFrame:
    """Product edges of every (spectrum, cluster): (spectrum, cluster_id, src_low, src_up, dst_low, dst_up, cost, dist).

    All steps that keep within the cost threshold, with the cost of the step and the least cost of its source. edges: spectrum, cluster_id, side, src,
    dst, weight. hits: spectrum, src (pair or boundary), id, cost and feature ids, the annotations that an edge's weight names. symmetric:
    spectrum, cluster_id, low, high; the sources and the sinks of both graphs are symmetric, too. ``both`` and ``of_node`` replace
    the costs that ``params`` describe. Clusters without edges have no rows.
    """
    return align_noted(materialize(annotated(edges.filter("side <> 'pivot'"), hits), "align-edges"), symmetric, params, both, of_node)


def align_noted(noted: DataFrame, symmetric: DataFrame, params: AlignmentParams, both: PairCost | None = None, of_node: NodeCost | None = None) -> DataFrame:
    """``align`` of lower and upper edges with their annotations: spectrum, cluster_id, side, src, dst, hits (cost and feature ids)."""
    mates = materialize(symmetric.select(*KEY, F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("up")).distinct().withColumn("_mates", F.lit(True)), "align-mates")
    if both is None and of_node is None:
        large = noted.groupBy(*KEY).count().filter(F.col("count") > SMALL).select(*KEY)
        if large.isEmpty():
            return _align_streamed(noted, mates, params)
        large = materialize(large, "align-large")
        part = lambda how: (df.join(large, KEY, how) for df in (noted, mates))
        return _align_streamed(*part("left_anti"), params).unionByName(_align_joined(*part("left_semi"), params))
    return _align_joined(noted, mates, params, both, of_node)


def _align_joined(noted: DataFrame, mates: DataFrame, params: AlignmentParams, both: PairCost | None = None, of_node: NodeCost | None = None) -> DataFrame:
    side = lambda name, x: noted.filter(F.col("side") == name).select(*KEY, F.col("src").alias(x), F.col("dst").alias(f"{x}_to"), F.col("hits").alias(f"{x}_hits"))
    lower, upper = side("lower", "low"), side("upper", "up")
    alone = lambda x: alone_cost(x, params)
    both = both or (lambda x, y: pair_cost(x, y, params))
    of_node = of_node or (lambda _low, _up, same: node_cost(same, params))
    low, up = F.col("low"), F.col("up")

    def within(steps: DataFrame, before: str) -> DataFrame:
        """Steps to nodes (low, up) with their total cost, as far as that keeps to the limit; ``before`` is the cost without the node's own."""
        same = F.coalesce(F.col("_mates"), F.lit(False)) | ((low == SOURCE) & (up == SOURCE)) | ((low == SINK) & (up == SINK))
        total = F.col(before) + of_node(low, up, same)
        return steps.join(mates, [*KEY, "low", "up"], "left").withColumn("dist", total).filter(F.col("dist") <= params.cost_threshold).drop("_mates")

    def onward(changed: DataFrame) -> DataFrame:
        steps = neighbours(changed, lower, upper, alone, both).groupBy(*KEY, "low_to", "up_to").agg(F.min(F.col("dist") + F.col("along")).alias("_before"))
        return within(steps.withColumnsRenamed({"low_to": "low", "up_to": "up"}), "_before")

    source = F.lit(SOURCE).cast("long")
    start = noted.select(*KEY).distinct().select(*KEY, source.alias("low"), source.alias("up"), F.lit(0.0).alias("dist"))
    reached = least_costs(start, onward, [*KEY, "low", "up"], "align-costs")
    steps = neighbours(reached, lower, upper, alone, both).withColumn("_before", F.col("dist") + F.col("along"))
    steps = steps.withColumnsRenamed({"low": "src_low", "up": "src_up", "dist": "src_dist"}).withColumnsRenamed({"low_to": "low", "up_to": "up"})
    return within(steps, "_before").select(*KEY, "src_low", "src_up", F.col("low").alias("dst_low"), F.col("up").alias("dst_up"), F.col("along").alias("cost"), F.col("src_dist").alias("dist"))
