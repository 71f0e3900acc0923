"""The cheapest candidates of one cluster after another, in sorted streams.

The edges of a cluster are shuffled once; its walks, their pairs and their spelling never leave the task, and only the cheapest sequences do. The clusters of some batches are
worked on at once: a level of their walks is one numpy call, and so is a block of pairs. A walk holds the set of its edges as bits and its residues as the number of a text;
strings are made only of pairs that may be among the cheapest. Pairs that cost more than the cheapest sequences found so far are not looked at, which changes no result.
Clusters with more than ``walks`` walks are named, not enumerated: they are left to joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import streams
from .product import KEY

#: Sums in another order may differ in their last digits; exact conditions follow.
SLACK = 1e-9
#: Pairs of a cluster up to which all of them are looked at at once.
FEW = 256
#: What stands for the rank in rows that name a cluster: with too many walks for a task, or for ``max_paths``.
LARGE, OVER = -1, -2


def _runs(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of the entries of sorted ``keys`` from ``low`` to below ``high``."""
    first = np.searchsorted(keys, low)
    return first, np.searchsorted(keys, high) - first


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class _Texts:
    """Sequences of symbols as numbers; 0 is the empty one. Equal numbers are equal sequences, for all clusters of a batch."""

    def __init__(self, symbols: list[str]) -> None:
        self.symbols, self.base = symbols, len(symbols) + 1
        self.parent, self.symbol = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.size = 1
        self.memo: dict[tuple[int, bool], str] = {}

    def name(self, code: int) -> str:
        """Of a lower and an upper symbol, numbered from 1 on, 0 for none."""
        low, up = divmod(code, self.base)
        x, y = (self.symbols[k - 1] if k else None for k in (low, up))
        return x or y or "" if x is None or y is None or x == y else f"{x}/{y}"

    def longer(self, text: np.ndarray, code: np.ndarray) -> np.ndarray:
        each, at = np.unique(text * self.base**2 + code, return_inverse=True)
        self.parent.append(each // self.base**2)
        self.symbol.append(each % self.base**2)
        self.size += len(each)
        return self.size - len(each) + at

    def close(self) -> None:
        self.parents, self.codes = np.concatenate(self.parent), np.concatenate(self.symbol)

    def spell(self, text: int, back: bool) -> str:
        if (text, back) not in self.memo:
            at, names = text, []
            while at:
                names.append(self.name(int(self.codes[at])))
                at = int(self.parents[at])
            self.memo[text, back] = "".join(names if back else reversed(names))
        return self.memo[text, back]


class _Clusters:
    """Rows of some whole clusters, numbered from 0: product edges, lower and upper edges with their annotation, and pivot edges."""

    def __init__(self, cluster: np.ndarray, kind: np.ndarray, columns: dict[str, np.ndarray], symbol: np.ndarray, symbols: list[str]) -> None:
        self.n = int(cluster[-1]) + 1
        a, b, c, d = (columns[x] for x in "abcd")
        product = kind == 0
        nodes = np.unique(np.concatenate([a, b, c[product], d[product]]))
        self.span = len(nodes)
        dense = lambda x: np.searchsorted(nodes, x)
        self.texts = _Texts(symbols)
        # product
        own, low, up = cluster[product], dense(a[product]), dense(b[product])
        to_low, to_up = dense(c[product]), dense(d[product])
        self.cost = columns["cost"][product]
        self.node, at = np.unique(np.concatenate([self.key(own, low, up), self.key(own, to_low, to_up)]), return_inverse=True)
        self.src, self.dst = at[: len(own)], at[len(own) :]
        self.own = self.node // self.span**2
        self.low_step, self.up_step = self.key(own, low, to_low), self.key(own, up, to_up)
        # annotated edges
        self.sides = []
        for k in (1, 2):
            rows = np.flatnonzero(kind == k)
            key = self.key(cluster[rows], dense(a[rows]), dense(b[rows]))
            order = np.argsort(key)
            rows = rows[order]
            self.sides.append((key[order], symbol[rows] + 1, columns["mass"][rows], d[rows]))
        # pivot edges in both directions; of several the one of the greatest weight
        rows = np.flatnonzero(kind == 3)
        x, y = dense(a[rows]), dense(b[rows])
        key, rows = np.concatenate([self.key(cluster[rows], x, y), self.key(cluster[rows], y, x)]), np.concatenate([rows, rows])
        order = np.lexsort((c[rows], key))
        order = order[np.diff(key[order], append=-1) != 0]
        self.pivot, rows = key[order], rows[order]
        self.pivot_cost, self.pivot_mass, self.pivot_symbol = columns["cost"][rows], 2 * columns["mass"][rows], symbol[rows]

    def key(self, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (own * self.span + x) * self.span + y

    def rests(self, limit: float) -> np.ndarray:
        """The least cost from a source to each node, as far as it is under ``limit``."""
        order = np.argsort(self.src, kind="stable")
        first = np.searchsorted(self.src[order], np.arange(len(self.node) + 1))
        rest = np.where(self.is_source, 0.0, np.inf)
        changed = np.flatnonzero(self.is_source)
        while len(changed):
            _, k = streams.spread(first[changed], first[changed + 1] - first[changed])
            k = order[k]
            total = rest[self.src[k]] + self.cost[k]
            better = (total < limit) & (total < rest[self.dst[k]])
            k, total = k[better], total[better]
            np.minimum.at(rest, self.dst[k], total)
            changed = np.unique(self.dst[k])
        return rest

    def steps(self, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        """Symbols (as one code), mass and orientation (1: b, 2: y) of product edges."""
        code, mass, end = np.zeros(len(edge), np.int64), np.zeros(len(edge)), np.zeros(len(edge), np.int64)
        for (key, symbol, weight, ends), step in zip(self.sides, (self.low_step, self.up_step), strict=True):
            at = _found(key, step[edge])
            code = code * self.texts.base + np.where(at >= 0, np.append(symbol, 0)[at], 0)
            mass += np.where(at >= 0, np.append(weight, 0.0)[at], 0.0)
            end |= np.where(at >= 0, np.append(ends, 0)[at], 0)
        return code, mass, end

    def bits(self, edge: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
        """The number of words of a set of edges, and the word and the bit of the lower and of the upper step of product edges."""
        keys, at = np.unique(np.concatenate([2 * self.low_step[edge], 2 * self.up_step[edge] + 1]), return_inverse=True)
        own = keys // (2 * self.span**2)
        place = (np.arange(len(keys)) - np.searchsorted(own, own))[at]
        word, bit = place // 64, np.uint64(1) << (place % 64).astype(np.uint64)
        half = len(edge)
        return int(word.max(initial=0)) + 1, [(word[:half], bit[:half]), (word[half:], bit[half:])]

    def walk(self, limit: float, most: int) -> None:
        """All walks from the ends back to the sources that cost less than ``limit``, as ``paths.trace`` makes them."""
        size = len(self.node)
        self.is_source = np.bincount(self.dst, minlength=size) == 0
        goes_on = np.bincount(self.src, minlength=size) > 0
        slack = limit + SLACK
        rest = self.rests(slack)
        back = np.flatnonzero(self.cost + rest[self.src] < slack)
        back = back[np.argsort(self.dst[back], kind="stable")]
        src, along = self.src[back], self.cost[back]
        first = np.searchsorted(self.dst[back], np.arange(size + 1))
        code, weight, end = self.steps(back)
        words, bits = self.bits(back)
        self.large = np.zeros(self.n, bool)
        made = np.zeros(self.n)
        at = np.unique(self.dst[back])
        at = at[~goes_on[at]]
        cost, head, mass, text = np.zeros(len(at)), at, np.zeros(len(at)), np.zeros(len(at), np.int64)
        mask = np.zeros((words, len(at)), np.uint64)
        done, begun = [], False
        while True:
            count = first[at + 1] - first[at]
            made += np.bincount(self.own[at], weights=count, minlength=self.n)
            self.large |= made > most
            owner, k = streams.spread(first[at], np.where(self.large[self.own[at]], 0, count))
            total = cost[owner] + along[k]
            fits = (total + rest[src[k]] < slack) & (total < limit)
            owner, k, cost = owner[fits], k[fits], total[fits]
            if not len(k):
                break
            at, mask = src[k], mask[:, owner]
            if begun:
                head, mass, text = head[owner], mass[owner] + weight[k], self.texts.longer(text[owner], code[k])
                for word, bit in bits:
                    mask[word[k], np.arange(len(k))] |= bit[k]
            else:  # the first step leads from the virtual node, and was counted by the pivot
                head, mass, text, begun = at, mass[owner], text[owner], True
            ends = self.is_source[at]
            done.append([x[..., ends] for x in (head, cost, mass, text, end[k], mask)])
            at, cost, head, mass, text, mask = (x[..., ~ends] for x in (at, cost, head, mass, text, mask))
        self.texts.close()
        if not done:
            done = [[np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), mask[:, :0]]]
        self.walks = [np.concatenate(x, axis=-1) for x in zip(*done, strict=True)]
        kept = ~self.large[self.own[self.walks[0]]]
        self.walks = [x[..., kept] for x in self.walks]

    def paired(self, most: int, few: int) -> dict[int, dict[str, tuple[float, float]]]:
        """The ``most`` cheapest sequences of each cluster, with their cost and mass: of equal costs of a sequence the least mass."""
        head, cost, mass, text, end, mask = self.walks
        self.best: dict[int, dict[str, tuple[float, float]]] = {}
        bound = np.full(self.n, np.inf)

        def heads(of: np.ndarray) -> tuple[np.ndarray, ...]:
            """Walks by head and cost, the heads, and each one's first walk and the number of its walks."""
            order = np.flatnonzero(of)
            order = order[np.lexsort((cost[order], head[order]))]
            each, first, count = np.unique(head[order], return_index=True, return_counts=True)
            return order, each, first, count

        prefix, p_head, p_first, p_count = heads(((end & 1) > 0) | (end == 0))
        suffix, s_head, s_first, s_count = heads(((end & 2) > 0) | (end == 0))
        # heads that meet: (u, w) and (x, v), with pivot edges u-v and w-x
        key, span = self.node[p_head], self.span
        own, u, w = key // span**2, key // span % span, key % span
        h, one = streams.spread(*_runs(self.pivot, self.key(own, u, 0), self.key(own, u + 1, 0)))
        k, two = streams.spread(*_runs(self.pivot, self.key(own[h], w[h], 0), self.key(own[h], w[h] + 1, 0)))
        h, one = h[k], one[k]
        g = _found(self.node[s_head], self.key(own[h], self.pivot[two] % span, self.pivot[one] % span))
        h, one, g = h[g >= 0], one[g >= 0], g[g >= 0]
        # a row is a prefix, the pivot's residue, and a group of suffixes by cost
        k, p = streams.spread(p_first[h], p_count[h])
        row_own, row_walk, row_pivot, row_group = own[h][k], prefix[p], one[k], g[k]
        base = cost[row_walk] + self.pivot_cost[row_pivot]
        group = np.repeat(np.arange(len(s_head)), s_count)
        step = 4.0 + 2 * (np.max(cost, initial=0.0) + np.max(base, initial=0.0))
        ladder = group * step + cost[suffix]

        def look(rows: np.ndarray, count: np.ndarray) -> None:
            """Take the first ``count`` suffixes of each row."""
            for part in streams.blocks(count):
                r, s = streams.spread(s_first[row_group[rows[part]]], count[part])
                r, s = rows[part][r], suffix[s]
                total = base[r] + cost[s]
                fits = (row_walk[r] != s) & (total <= bound[row_own[r]])
                for word in mask:
                    fits &= (word[row_walk[r]] & word[s]) == 0
                r, s, total = r[fits], s[fits], total[fits]
                self._take(row_own[r], total, (mass[row_walk[r]] + self.pivot_mass[row_pivot[r]] + mass[s]) / 2, (text[row_walk[r]], self.pivot_symbol[row_pivot[r]], text[s]), bound, most)

        every = s_count[row_group]
        many = np.bincount(row_own, weights=every, minlength=self.n) > few
        heavy = np.flatnonzero(many[row_own])
        look(heavy, np.ones(len(heavy), np.int64))  # bounds from each row's cheapest suffix
        look(np.flatnonzero(~many[row_own]), every[~many[row_own]])
        heavy = heavy[np.argsort(base[heavy], kind="stable")]
        room = np.minimum(bound[row_own[heavy]] - base[heavy] + streams.SLACK, step / 2)
        upto = np.searchsorted(ladder, row_group[heavy] * step + np.maximum(room, -1.0), "right") - s_first[row_group[heavy]]
        look(heavy, np.maximum(upto, 0))
        return self.best

    def _take(self, own: np.ndarray, cost: np.ndarray, mass: np.ndarray, parts: tuple[np.ndarray, ...], bound: np.ndarray, most: int) -> None:
        """Add pairs to the best of their clusters, and lower the ``bound`` of what may still be among them."""
        order = np.lexsort((mass, cost, own))
        code = np.zeros(len(order), np.int64)
        for x in (own, *parts):  # only the cheapest of equal spellings
            code = np.unique(code * (int(x.max(initial=0)) + 1) + x, return_inverse=True)[1]
        order = order[np.sort(np.unique(code[order], return_index=True)[1])]
        own, cost, mass, prefix, pivot, suffix = (x[order].tolist() for x in (own, cost, mass, *parts))
        begin = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own)).tolist()
        spell, names = self.texts.spell, self.texts.symbols
        for i, j in zip(begin[:-1], begin[1:], strict=True):
            best = self.best.setdefault(own[i], {})
            last = sorted(x for x, _ in best.values())[most - 1] if len(best) >= most else np.inf
            for k in range(i, j):
                if cost[k] > last:
                    break
                sequence, now = spell(prefix[k], True) + names[pivot[k]] + spell(suffix[k], False), (cost[k], mass[k])
                if sequence not in best or now < best[sequence]:
                    best[sequence] = now
                    if len(best) >= most:
                        last = sorted(x for x, _ in best.values())[most - 1]
            kept = sorted(best.items(), key=lambda x: (x[1][0], x[0]))[:most]
            self.best[own[i]] = dict(kept)
            bound[own[i]] = last


def cheapest(product: DataFrame, noted: DataFrame, limit: float, most: int, walks: int, max_paths: int | None = None) -> DataFrame:
    """(spectrum, cluster_id, rank, sequence, cost, mass): the ``most`` cheapest sequences of each cluster, from rank 0.

    product: KEY, src_low, src_up, dst_low, dst_up, cost, all edges of the alignment. noted: KEY, side, src, dst, weight, symbol, mass, cost, ends: the edges of the graphs with
    their cheapest annotation, and what an edge from the source says of its series: 1 for b, 2 for y, else 0. A rank of LARGE or OVER names a cluster that isn't enumerated.
    """
    few = FEW
    none = lambda kind: F.lit(None).cast(kind)
    steps = product.select(*KEY, F.lit(0).alias("_kind"), F.col("src_low").alias("a"), F.col("src_up").alias("b"), F.col("dst_low").alias("c"), F.col("dst_up").alias("d"), "cost", F.lit(0.0).alias("mass"), none("string").alias("symbol"))
    kind = F.when(F.col("side") == "lower", 1).when(F.col("side") == "upper", 2).otherwise(3)
    edges = noted.select(*KEY, kind.alias("_kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("c"), F.col("ends").cast("long").alias("d"), "cost", "mass", "symbol")
    schema = StructType([noted.schema[c] for c in KEY]).add("rank", "integer").add("sequence", "string").add("cost", "double").add("mass", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cluster in streams.whole_segments(batches, KEY):
            columns = {c: table.column(c).to_numpy() for c in ("a", "b", "c", "d", "cost", "mass")}
            symbol = table.column("symbol").combine_chunks().dictionary_encode()
            symbol = symbol.chunk(0) if isinstance(symbol, pa.ChunkedArray) else symbol
            at = _Clusters(cluster, table.column("_kind").to_numpy(), columns, symbol.indices.fill_null(-1).to_numpy(), symbol.dictionary.to_pylist())
            at.walk(limit, walks)
            over = np.zeros(at.n, bool) if max_paths is None else np.bincount(at.own[at.walks[0]], minlength=at.n) > max_paths
            rows = [(c, OVER, None, None, None) for c in np.flatnonzero(over).tolist()] + [(c, LARGE, None, None, None) for c in np.flatnonzero(at.large).tolist()]
            for c, best in at.paired(most, few).items():
                rows += [(c, k, sequence, *x) for k, (sequence, x) in enumerate(best.items())]
            if rows:
                own, *rest = zip(*rows, strict=True)
                held = table.select(KEY).take(pa.array(np.searchsorted(cluster, own)))
                yield from pa.Table.from_arrays([*held.columns, *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.string(), pa.float64(), pa.float64()), strict=True))], names=schema.names).combine_chunks().to_batches()

    return streams.in_segments(steps.unionByName(edges), KEY, ["_kind"]).mapInArrow(run, schema)
