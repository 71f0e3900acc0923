"""Alignment and tracing in Spark against plain searches, group by group."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from denovospark.functions.params import AlignmentParams
from denovospark.operators import paths, product

FEATURES = product.FEATURES


def plain_align(edges, hits, symmetric, p, pair=None, of_node=None):
    """{(cluster, from, to): (cost, dist)} by relaxing until nothing changes."""
    notes = defaultdict(list)
    for spectrum, src, i, cost, *features in hits:
        notes[spectrum, src, i].append((cost, features))
    out = {}
    for key in sorted({e[:2] for e in edges}):
        graphs, said = {"lower": defaultdict(list), "upper": defaultdict(list)}, {}
        for s, c, side, a, b, w in edges:
            if (s, c) == key and side != "pivot":
                graphs[side][a].append(b)
                said[side, a, b] = notes[s, "boundary" if a < 0 else "pair", w]
        mates = {(low, up) for s, c, low, up in symmetric if (s, c) == key} | {(-1, -1), (-2, -2)}

        def edge(a, b):
            low, up = (said["lower", a[0], b[0]] if a[0] != b[0] else []), (said["upper", a[1], b[1]] if a[1] != b[1] else [])
            if b == (-2, -2) and a[0] != -2 and a[1] != -2:
                return 0.0
            if pair and a[0] != b[0] and a[1] != b[1]:
                return pair(low, up)
            if not low or not up:
                return min((c for c, _ in low or up), default=0.0) + p.edge_gap
            return min(x + y + sum((p.edge_match if f == g else p.edge_mismatch) for f, g in zip(fx, fy)) for x, fx in low for y, fy in up)

        def node(n):
            return of_node(n, n in mates) if of_node else p.node_match if n in mates else p.node_mismatch

        def onward(n):
            down, up = graphs["lower"].get(n[0], []), graphs["upper"].get(n[1], [])
            return [(x, y) for x in down for y in up] + [(x, n[1]) for x in down] + [(n[0], y) for y in up]

        dist, changed = {(-1, -1): 0.0}, [(-1, -1)]
        while changed:
            n = changed.pop()
            for m in onward(n):
                total = dist[n] + edge(n, m) + node(m)
                if total <= p.cost_threshold and total < dist.get(m, np.inf):
                    dist[m] = total
                    changed.append(m)
        for n, d in dist.items():
            for m in onward(n):
                if d + edge(n, m) + node(m) <= p.cost_threshold:
                    out[key, n, m] = (edge(n, m), d)
    return out


def plain_trace(product_edges, limit):
    """[(key, cost, walk)] by following every edge back from every end."""
    out = []
    for key in sorted({e[0] for e in product_edges}):
        back, heads = defaultdict(list), set()
        for k, n, m, cost in product_edges:
            if k == key:
                back[m].append((n, cost))
                heads.add(n)
        stack = [(0.0, [n]) for n in back if n not in heads]
        while stack:
            cost, walk = stack.pop()
            if walk[-1] not in back:
                out.append((key, cost, walk))
            stack += [(cost + c, [*walk, n]) for n, c in back.get(walk[-1], []) if cost + c < limit]
    return sorted(out, key=lambda x: (x[0], x[1], x[2]))


@pytest.fixture(scope="module")
def graphs():
    """Random graphs of several clusters, whose edges rise in the lower and fall in the upper one; some edges lack annotations."""
    draw = np.random.default_rng(4)
    edges, hits, symmetric, number = [], [], [], 0
    for spectrum in range(6):
        for cluster in range(1 + spectrum % 2):
            for side in ("lower", "upper"):
                found = {(-1, int(b)) for b in draw.integers(0, 9, 3)} | {(int(a), -2) for a in draw.integers(0, 9, 3)}
                found |= {(int(min(a, b)), int(max(a, b))) for a, b in draw.integers(0, 9, (14, 2)) if a != b}
                for a, b in sorted(found):
                    number += 1
                    edges.append((spectrum, cluster, side, a, b, number if b != -2 else -1))
                    for _ in range(draw.integers(0, 4) if b != -2 else 0):
                        hits.append((spectrum, "boundary" if a < 0 else "pair", number, float(draw.integers(0, 8)) / 4, *(int(x) for x in draw.integers(0, 3, 4))))
            symmetric += [(spectrum, cluster, int(a), int(b)) for a, b in draw.integers(0, 9, (12, 2))]
            edges.append((spectrum, cluster, "pivot", 0, 1, 5))
    return edges, hits, symmetric


@pytest.fixture(scope="module")
def tables(spark, graphs):
    edges, hits, symmetric = graphs
    return (
        spark.createDataFrame(edges, "spectrum long, cluster_id int, side string, src long, dst long, weight long"),
        spark.createDataFrame(hits, "spectrum long, src string, id long, cost double, " + ", ".join(f"{f} int" for f in FEATURES)),
        spark.createDataFrame(symmetric + symmetric[:5], "spectrum long, cluster_id int, low int, high int"),
    )


def rows_of(aligned):
    return {((r.spectrum, r.cluster_id), (r.src_low, r.src_up), (r.dst_low, r.dst_up)): (r.cost, r.dist) for r in aligned.collect()}


@pytest.mark.parametrize("limit", [0.5, 4.0, 7.0])
def test_align_equals_relaxation(graphs, tables, limit):
    p = AlignmentParams(cost_threshold=limit)
    got, want = rows_of(product.align(*tables, p)), plain_align(*graphs, p)
    assert got.keys() == want.keys() and (limit < 1 or len(got) > 100)
    assert all(np.allclose(got[k], want[k]) for k in got)


def test_align_with_costs_of_the_user(graphs, tables):
    p = AlignmentParams(cost_threshold=3.0)
    got = rows_of(product.align(*tables, p, both=lambda low, up: F.abs(F.size(low) - F.size(up)).cast("double"), of_node=lambda low, up, same: F.when(same, 0.0).otherwise(F.abs(low - up) / 4.0)))
    want = plain_align(*graphs, p, pair=lambda low, up: float(abs(len(low) - len(up))), of_node=lambda n, same: 0.0 if same else abs(n[0] - n[1]) / 4)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


@pytest.mark.parametrize("limit", [2.0, 5.0, 9.0])
def test_trace_equals_all_walks(graphs, tables, limit):
    p = AlignmentParams(cost_threshold=6.0)
    aligned = product.align(*tables, p)
    want = plain_trace([(k, n, m, c) for (k, n, m), (c, _) in plain_align(*graphs, p).items()], limit)
    got = sorted(((r.spectrum, r.cluster_id), r.cost, list(zip(r.lower, r.upper)), r.path_id) for r in paths.trace(aligned, limit).collect())
    assert [(k, c, w) for k, c, w, _ in got] == want and (limit < 5 or len(want) > 5)
    assert all(a[3] == 0 if k == 0 or got[k - 1][0] != a[0] else a[3] == got[k - 1][3] + 1 for k, a in enumerate(got))


def test_no_walk_is_made_that_cannot_end(spark, monkeypatch):
    """A comb whose teeth are dear at their far ends: without the rest, every tooth would be walked nearly to its end."""
    rows = []
    for tooth in range(200):
        chain = [(-1, -1)] + [(tooth * 20 + k, 0) for k in range(10)] + [(-2, -2)]
        rows += [(1, 0, *a, *b, 9.0 if k == 0 and tooth else 0.1, 0.0) for k, (a, b) in enumerate(zip(chain, chain[1:]))]
    df = spark.createDataFrame(rows, "spectrum long, cluster_id int, src_low long, src_up long, dst_low long, dst_up long, cost double, dist double")
    made, real = [], paths.materialize
    monkeypatch.setattr(paths, "materialize", lambda t, name: _counted(real, made, t, name))
    got = paths.trace(df, 5.0).collect()
    assert len(got) == 1 and sum(made) == 11


def _counted(real, made, table, name):
    out = real(table, name)
    if name == "path-walks":
        made.append(out.count())
    return out


def test_paths_are_not_capped(spark):
    """14 layers of two nodes: 2 ** 13 paths to either of the last two, from either of the first two."""
    rows = [(1, 0, k, x, k + 1, y, 0.0, 0.0) for k in range(13) for x in (0, 1) for y in (0, 1)]
    df = spark.createDataFrame(rows, "spectrum long, cluster_id int, src_low long, src_up long, dst_low long, dst_up long, cost double, dist double")
    assert paths.trace(df, 1.0).count() == 2**14
    with pytest.raises(ValueError):
        paths.trace(df, 1.0, 100)
    assert paths.trace(df.limit(0), 1.0).count() == 0
    assert paths.trace(df, 0.0).count() == 0


def test_clusters_of_a_batch_are_aligned_at_once(spark, monkeypatch):
    """One call for all clusters of a batch, with any feature ids and costs, and the result of the joins."""
    draw = np.random.default_rng(11)
    edges, hits = [], []
    for cluster in range(4):
        for side in ("lower", "upper")[: 1 if cluster == 3 else 2]:
            for a, b in sorted({(-1, int(x)) for x in draw.integers(0, 6, 2)} | {(int(x), -2) for x in draw.integers(0, 6, 2)} | {(int(min(x)), int(max(x))) for x in draw.integers(0, 6, (8, 2)) if x[0] != x[1]}):
                edges.append(("w", cluster, side, a, b, len(edges) if b != -2 else -1))
                hits += [("w", "boundary" if a < 0 else "pair", len(edges) - 1, float(c) / 8, -1, 70000 + int(c), int(c), 300) for c in draw.integers(0, 3, draw.integers(0, 3))] if b != -2 else []
    tables = [
        spark.createDataFrame(edges, "spectrum string, cluster_id int, side string, src long, dst long, weight long"),
        spark.createDataFrame(hits, "spectrum string, src string, id long, cost double, amino_id int, left_loss_id int, right_loss_id int, mod_id int"),
        spark.createDataFrame([("w", 0, 1, 1), ("w", 1, 2, 3), ("w", 2, 40, 2), ("v", 0, 1, 1)], "spectrum string, cluster_id int, low int, high int"),
    ]
    p = AlignmentParams(5.0, 0.25, 0.75, 0.125, 0.5, 1.5)
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in product.align(*tables, p).collect())
    streamed = rows()
    monkeypatch.setattr(product, "SMALL", 0)
    assert streamed == rows() and {r[1] for r in streamed} == {0, 1, 2, 3} and len(streamed) > 50
