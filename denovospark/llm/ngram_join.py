"""Operator 8: exact n-gram Jaccard self-join with prefix trees.

1. Every text becomes a set of 63-bit shingle keys; equal sets are one class, named by a 128-bit fingerprint.
2. Keys are in one global order: by hash, but keys that many texts hold come last (COMMON of them at most, counted over all
   texts; any order gives the same links, this one keeps shared passages out of the prefixes). Two sets that are similar
   enough share a key among their first n - ceil(t n) + 1, so only these are shuffled, as arrays by ranges of the hash.
3. A range finds the keys that several classes share. Each class first meets the one that shares most keys with it
   (in keys of many classes: their least class). Links found are closed to components; similarities of FAMILY percent or
   more are closed to families, which hold nearly all pairs that share keys.
4. Within a family, the classes outside its largest component meet all its classes, in blocks of BLOCK: a block is a prefix
   tree, which a block of probes traverses. No pairs are listed before. Pairs of different families are listed by the ranges
   in which they share keys, if their sizes and the number of shared keys allow a link, and meet in trees of a probe's partners.
5. A prefix tree is walked level by level. The overlap with a shared beginning is counted once; a subtree is left when the keys
   that remain on either side can't reach the overlap that its shortest set would need, and when all its sets are in the
   probe's component already. Links found while a block is traversed join components for the probes that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix, pack, released, unpack
from .components import connected_components

COMMON, COMMON_FROM = 1 << 20, 6
_LAST = np.uint64(1 << 63)
#: Similarity in percent from which two classes are of one family.
FAMILY = 30
#: Classes and keys of a prefix tree, about.
BLOCK, BLOCK_KEYS = 128, 1 << 21
#: Classes of a key up to which all their pairs are counted at once.
SMALL_GROUP = 16
#: Cells of a matrix of pairs that is made at once.
CELLS = 1 << 22
#: Keys in a range, and ranges into which an array is cut at once.
RANGE_KEYS, FAN = 1_500_000, 64
#: Classes whose sets are found by a broadcast filter of 64 to 128 bits each; more are found by a join.
FILTER_CLASSES = 1 << 20


_ROOT = 0x7FB5D329728EA185
#: A number for each byte: the same for a letter in either case, 0 for white space.
_BYTES = np.arange(256, dtype=np.uint64)
_BYTES[65:91] += np.uint64(32)
_SPACE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_BYTES = np.where(_SPACE, np.uint64(0), mix(_BYTES + np.uint64(0x1F83D9ABFB41BD6B)))


class Shingles:
    """Keys of texts' shingles. A word's hash is the sum of its bytes' numbers times powers of _ROOT, modulo 2^64."""

    def __init__(self, width: int = 5) -> None:
        self.width, self.powers, self.inverses = width, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.ones(max(n, 1 << 16), np.uint64)
            steps[1:] = _ROOT
            self.powers = np.cumprod(steps)
            steps[1:] = pow(_ROOT, -1, 1 << 64)
            self.inverses = np.cumprod(steps)

    def words(self, text: str | None) -> np.ndarray:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)
        self._grow(len(data))
        space = np.concatenate([[True], _SPACE[data], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.append(np.uint64(0), np.cumsum(_BYTES[data] * self.powers[: len(data)]))
        return mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def keys(self, text: str | None) -> np.ndarray:
        """Sorted distinct 63-bit keys of the text's shingles; of fewer words, the whole sequence is one."""
        h = self.words(text)
        if not len(h):
            return np.empty(0, np.uint64)
        width = min(self.width, len(h))
        # word hashes are uniform already: a polynomial in an odd number keeps their order apart, one finaliser spreads it
        out = h[: len(h) - width + 1] + np.uint64(width)
        for k in range(1, width):
            out = out * np.uint64(_ROOT) + h[k : len(h) - width + 1 + k]
        out = np.sort(mix(out) >> np.uint64(1))
        return out[np.append(True, out[1:] != out[:-1])]


def fingerprint(keys: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(keys.tobytes())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def ordered(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys in the global order: common ones get the highest bit."""
    if len(common) and len(keys):
        at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
        keys = np.sort(np.where(common[at] == keys, keys | _LAST, keys))
    return keys


def _survey(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A row (id, n, fp) for each text, and a last one for each batch with the keys that several of its classes hold."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    shingles = Shingles(width)
    names = ["id", "n", "fp", "keys", "held"]
    for batch in batches:
        n, fps, sets, seen = [], [], [], set()
        for value in batch.column(1):
            keys = shingles.keys(value.as_py())
            n.append(len(keys))
            fps.append(fingerprint(keys) if len(keys) else None)
            if len(keys) and fps[-1] not in seen:
                seen.add(fps[-1])
                sets.append(keys)
        several = ([], [])
        if sets:
            keys, counts = np.unique(np.concatenate(sets), return_counts=True)
            several = (keys[counts > 1].astype(np.int64).tolist(), counts[counts > 1].tolist())
        rows = len(n)
        own = [batch.column(0).cast(pa.int64()), pa.array(n, kinds[1]), pa.array(fps, kinds[2]), pa.nulls(rows, kinds[3]), pa.nulls(rows, kinds[4])]
        yield pa.RecordBatch.from_arrays(own, names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], k) for k in kinds[:3]] + [pa.array([s], kinds[3]) for s in several], names=names)


_NAME = np.dtype((np.void, 16))


def _names(x: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
_MESSAGE = "range int, tokens binary, at binary, fps binary, sizes binary"


def _cut(flat: np.ndarray, node: np.ndarray, names: np.ndarray, length: np.ndarray, part: int, fan: int, width: int) -> pa.RecordBatch:
    """Messages for the ``fan`` parts of range ``part``, which is ``width`` keys wide: keys, places of their classes, names and sizes."""
    by = np.argsort(flat & ~_LAST, kind="stable")
    flat, node = flat[by], node[by]
    edges = np.array([min((part * fan + k) * width, (1 << 63) - 1) for k in range(1, fan)], np.uint64)
    cuts = [0, *np.searchsorted(flat & ~_LAST, edges).tolist(), len(flat)]
    out = []
    for k in range(fan):
        if cuts[k] < cuts[k + 1]:
            own, at = np.unique(node[cuts[k] : cuts[k + 1]], return_inverse=True)
            out.append((part * fan + k, flat[cuts[k] : cuts[k + 1]].tobytes(), at.astype(np.int32).tobytes(), names[own].tobytes(), length[own].tobytes()))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["range", "tokens", "at", "fps", "sizes"])


def _prefixes(batches: Iterator[pa.RecordBatch], common: np.ndarray, fan: int, width: int, percent: int) -> Iterator[pa.RecordBatch]:
    shingles = Shingles(width)
    for batch in batches:
        seen: set[bytes] = set()
        tokens, sizes, fps = [], [], []
        for value in batch.column(0):
            keys = shingles.keys(value.as_py())
            if len(keys) and (fp := fingerprint(keys)) not in seen:
                seen.add(fp)
                fps.append(fp)
                sizes.append(len(keys))
                tokens.append(ordered(keys, common)[: prefix_length(len(keys), percent)])
        if tokens:
            node = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            yield _cut(np.concatenate(tokens), node, np.frombuffer(b"".join(fps), _NAME), np.array(sizes, np.int32), 0, fan, -(-(1 << 63) // fan))


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, places, names and sizes of messages put together."""
    tokens, at, fps, sizes, held = [], [], [], [], 0
    for k in range(table.num_rows):
        tokens.append(np.frombuffer(table.column("tokens")[k].as_py(), np.uint64))
        at.append(np.frombuffer(table.column("at")[k].as_py(), np.int32) + np.int32(held))
        fps.append(np.frombuffer(table.column("fps")[k].as_py(), _NAME))
        sizes.append(np.frombuffer(table.column("sizes")[k].as_py(), np.int32))
        held += len(sizes[-1])
    return np.concatenate(tokens), np.concatenate(at), np.concatenate(fps), np.concatenate(sizes)


def _cut_again(fan: int, width: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: pa.Table.from_batches([_cut(*_joined(table), table.column("range")[0].as_py(), fan, width)])


def fans(ranges: int) -> list[int]:
    """Into how many parts to cut at each of the steps that give ``ranges`` ranges or a few more; FAN at most."""
    steps = 1
    while FAN**steps < ranges:
        steps += 1
    fan = 1
    while fan**steps < ranges:
        fan += 1
    return [fan] * steps


def dealt(messages: DataFrame, steps: list[int], blocks: int) -> DataFrame:
    """Messages of whole ranges, from those of ``blocks`` batches that are cut by the first of ``steps``.

    At each further step as many messages of a range are put together as it is cut into parts: a step gives no more messages
    than the first, so their number grows with the data, not with its square, and none becomes smaller.
    """
    width = -(-(1 << 63) // steps[0])
    for fan in steps[1:]:
        width = -(-width // fan)
        groups = -(-blocks // fan)
        message = F.pmod(F.xxhash64("tokens"), F.lit(groups)).alias("message")
        messages = messages.withColumn("message", message).groupBy("range", "message").applyInArrow(_cut_again(fan, width), _MESSAGE)
        blocks = groups
    return messages


def may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


_SHARED = "range int, a binary, b binary, size_a int, size_b int, keys long, large boolean, tokens binary, nodes binary, fps binary, sizes binary"
def _shared(table: pa.Table, percent: int) -> pa.Table:
    """The keys of a range that several classes hold.

    A row for each pair of classes within groups of SMALL_GROUP at most, with the number of keys that both hold; for each class
    in larger groups, with the least class of the group instead. One row more has the keys and their classes as arrays.
    """
    tokens, at, name, size = _joined(table)
    parts = name.view(">u8").reshape(-1, 2)
    order = np.lexsort((parts[:, 1], parts[:, 0]))  # classes by name; copies from several batches are one
    new = np.append(True, (parts[order][1:] != parts[order][:-1]).any(1))
    rank = np.empty(len(name), np.int32)
    rank[order] = np.cumsum(new) - 1
    name, size = name[order][new], size[order][new]
    nodes = rank[at]
    by = np.argsort(tokens, kind="stable")
    tokens, nodes = tokens[by], nodes[by]
    del by, at, parts, order, rank
    same = tokens[1:] == tokens[:-1]
    several = np.append(same, False) | np.append(False, same)  # most keys have one class
    tokens, nodes = tokens[several], nodes[several]
    by = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[by], nodes[by]
    keep = np.append(True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1]))[: len(tokens)]
    tokens, nodes = tokens[keep], nodes[keep]
    group = np.cumsum(np.append(0, tokens[1:] != tokens[:-1]))[: len(tokens)]
    # a class stays if another of its group has a size that allows a link: the nearest smaller or larger one decides
    by = np.lexsort((size[nodes], group))
    g, s = group[by], size[nodes[by]].astype(np.int64)
    near = (g[1:] == g[:-1]) & may_link(s[1:], s[:-1], percent)
    stays = np.zeros(len(tokens), bool)
    if len(tokens):
        stays[by] = np.append(near, False) | np.append(False, near)
    tokens, nodes = tokens[stays], nodes[stays]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)])
    count = np.repeat(np.diff(np.append(first, len(tokens))), np.diff(np.append(first, len(tokens))))
    codes = []
    for step in range(1, SMALL_GROUP):
        a, b = nodes[:-step], nodes[step:]
        here = (tokens[step:] == tokens[:-step]) & (count[step:] <= SMALL_GROUP)
        if not here.any():
            break
        a, b = a[here], b[here]
        codes.append((a.astype(np.int64) << 32 | b)[may_link(size[a].astype(np.int64), size[b].astype(np.int64), percent)])
    centre = np.repeat(nodes[first], np.diff(np.append(first, len(tokens))))
    far = (count > SMALL_GROUP) & (centre != nodes)
    pairs, keys = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_counts=True)
    stars, star_keys = np.unique(centre[far].astype(np.int64) << 32 | nodes[far], return_counts=True)
    large = np.append(np.zeros(len(pairs), bool), np.ones(len(stars), bool))
    pairs, keys = np.append(pairs, stars), np.append(keys, star_keys)
    own, nodes = np.unique(nodes, return_inverse=True)
    n = len(pairs)
    of = table.column("range")[0].as_py()
    rows = [
        pa.array(np.full(n, of, np.int32)), _names(name[pairs >> 32]), _names(name[pairs & 0xFFFFFFFF]), pa.array(size[pairs >> 32]), pa.array(size[pairs & 0xFFFFFFFF]),
        pa.array(keys.astype(np.int64)), pa.array(large), *(pa.nulls(n, pa.binary()) for _ in range(4)),
    ]
    arrays = [pack(tokens), pack(nodes.astype(np.int32)), name[own].tobytes(), size[own].tobytes()]
    none = [pa.nulls(1, k) for k in (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())]
    last = [pa.array([of], pa.int32()), *none, *(pa.array([x], pa.binary()) for x in arrays)]
    names = [c.split()[0] for c in _SHARED.split(", ")]
    return pa.concat_tables([pa.Table.from_arrays(rows, names=names), pa.Table.from_arrays(last, names=names)])


def _added(found: tuple[np.ndarray, np.ndarray], pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs, with those found before."""
    codes, at = np.unique(np.concatenate([found[0], *pairs]), return_inverse=True)
    times = np.concatenate([found[1], *(np.ones(len(p), np.int64) for p in pairs)])
    return codes, np.bincount(at, times, len(codes)).astype(np.int64)


def enough_keys(percent: int) -> Column:
    """Whether the keys that two prefixes share leave a chance of a link.

    All shared keys up to the end of the prefix that ends first lie in both prefixes; beyond it, that set has
    ceil(t n) - 1 keys left. Together they have to reach the overlap t / (1 + t) (n_a + n_b).
    """
    beyond = F.ceil(F.lit(percent) * F.greatest("size_a", "size_b") / 100) - 1
    return (100 + percent) * (F.col("keys") + beyond) >= percent * (F.col("size_a") + F.col("size_b"))



def _across(table: pa.Table, percent: int) -> pa.Table:
    """Of a range: all pairs of classes that share a key, have sizes that allow a link, and lie in different families."""
    family_of: dict[bytes, bytes] = {}
    packed = []
    for fp, family, *arrays in zip(*(table.column(c).to_pylist() for c in ("fp", "family", "tokens", "nodes", "fps", "sizes")), strict=True):
        if fp is None:
            packed.append(arrays)
        else:
            family_of[fp] = family
    out: list[pa.Table] = []
    for tokens, nodes, fps, sizes in packed:
        tokens, nodes = unpack(tokens, np.uint64), unpack(nodes, np.int32)
        names, size = np.frombuffer(fps, _NAME), np.frombuffer(sizes, np.int32).astype(np.int64)
        number: dict[bytes, int] = {}
        family = np.array([number.setdefault(family_of.get(bytes(f), bytes(f)), len(number)) for f in names], np.int64)
        by = np.lexsort((family[nodes], tokens))
        tokens, nodes = tokens[by], nodes[by]
        starts = np.append(np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[: len(tokens)]), len(tokens))
        pairs: list[np.ndarray] = []
        held, found = 0, (np.empty(0, np.int64), np.empty(0, np.int64))
        for a, b in zip(starts, starts[1:], strict=False):
            own = nodes[a:b]
            r = family[own]
            if r[0] == r[-1]:
                continue
            cuts = np.append(np.flatnonzero(np.append(True, r[1:] != r[:-1])), len(own))
            for x, y in zip(cuts, cuts[1:-1], strict=False):
                rest = own[y:]
                step = max(1, CELLS // len(rest))
                for low in range(x, y, step):
                    one = own[low : min(low + step, y)]
                    i, k = np.nonzero(may_link(size[one][:, None], size[rest][None, :], percent))
                    pairs.append(np.minimum(one[i], rest[k]).astype(np.int64) << 32 | np.maximum(one[i], rest[k]))
                    held += len(i)
                    if held > CELLS:
                        found, pairs, held = _added(found, pairs), [], 0
        codes, keys = _added(found, pairs)
        one, two = (codes >> 32).astype(np.int64), codes & 0xFFFFFFFF
        out.append(pa.Table.from_arrays([_names(names[one]), _names(names[two]), pa.array(size[one]), pa.array(size[two]), pa.array(keys)], names=["a", "b", "size_a", "size_b", "keys"]))
    none = [pa.array([], pa.binary()), pa.array([], pa.binary()), *(pa.array([], pa.int64()) for _ in range(3))]
    return pa.concat_tables([pa.Table.from_arrays(none, names=["a", "b", "size_a", "size_b", "keys"]), *out])


def for_tree(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The keys in the order of the trees: common ones first, as similar sets begin alike then."""
    return np.sort(ordered(keys, common) ^ _LAST)


def _sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None, common: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """(id, fp, keys) of the rows whose id passes the filter."""
    shingles = Shingles(width)
    for batch in batches:
        at = batch.column(2).to_numpy(zero_copy_only=False)
        rows = np.arange(len(at)) if wanted is None else np.flatnonzero((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        fps, sets = [], []
        for k in rows:
            keys = shingles.keys(batch.column(1)[int(k)].as_py())
            fps.append(fingerprint(keys))
            sets.append(for_tree(keys, common).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(rows)), pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["id", "fp", "keys"])


class PrefixTree:
    """Ordered sets as a tree: sets that begin alike share the path of their beginning. ``marks``: the sets' components."""

    def __init__(self, sets: list[np.ndarray], marks: np.ndarray | None = None) -> None:
        number = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        held = [sets[k] for k in number]
        sizes = np.array([len(s) for s in held])
        marks = np.zeros(len(sets), np.int64) if marks is None else np.asarray(marks)[number]
        shared = np.zeros(len(sets) + 1, np.int64)  # keys that a set's path shares with the set before it
        for k in range(1, len(held)):
            m = min(len(held[k - 1]), len(held[k]))
            differs = np.flatnonzero(held[k - 1][:m] != held[k][:m])
            shared[k] = differs[0] if len(differs) else m
        nodes, edges = [], []
        todo = [(0, len(held), 0)] if held else []
        for low, high, begin in todo:  # grows: children of a node stand together
            leaf = high - low == 1
            end = len(held[low]) if leaf else int(shared[low + 1 : high].min())
            cuts = [] if leaf else [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] == end)).tolist(), high]
            own = marks[low:high]
            nodes.append((end, sizes[low:high].min(), sizes[low:high].max(), number[low] if leaf else -1, own[0] if (own == own[0]).all() else -1, len(todo), max(len(cuts) - 1, 0)))
            edges.append((held[low][begin:end], held[low][end - 1] if end else np.uint64(0)))
            todo += [(a, b, end) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.end, self.shortest, self.longest, self.leaf, self.mark, self.child, self.children = np.array(nodes, np.int64).reshape(-1, 7).T
        self.edges = np.concatenate([np.empty(0, np.uint64), *(e for e, _ in edges)])
        self.last = np.array([x for _, x in edges], np.uint64)
        self.length = np.array([len(e) for e, _ in edges], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def similar(self, probe: np.ndarray, percent: int, joined: np.ndarray | None = None, own: int = -1) -> list[tuple[int, int]]:
        """(number, overlap) of the sets whose Jaccard similarity with ``probe`` is ``percent`` or more.

        Without the subtrees all of whose sets are of the component ``own``; ``joined`` gives for each mark its component now.
        """
        found: list[tuple[int, int]] = []
        at, overlap, p = np.zeros(min(len(self.end), 1), np.int64), np.zeros(1, np.int64), len(probe)
        while len(at) and p:
            if joined is not None:
                other = (self.mark[at] < 0) | (joined[self.mark[at]] != own)
                at, overlap = at[other], overlap[other]
                if not len(at):
                    break
            length = self.length[at]
            ends = np.cumsum(length)
            keys = self.edges[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1])]
            hits = np.append(0, np.cumsum(probe[np.minimum(np.searchsorted(probe, keys), p - 1)] == keys))
            overlap = overlap + hits[ends] - hits[ends - length]
            end = self.end[at]
            rest = np.where(end > 0, p - np.searchsorted(probe, self.last[at], "right"), p)
            best = overlap + np.minimum(rest, self.longest[at] - end)
            may = 100 * best >= percent * (p + self.shortest[at] - best)
            at, overlap = at[may], overlap[may]
            leaf = self.leaf[at]
            found += zip(leaf[leaf >= 0].tolist(), overlap[leaf >= 0].tolist(), strict=True)
            children = self.children[at]
            ends = np.cumsum(children)
            at, overlap = np.repeat(self.child[at] - ends + children, children) + np.arange(ends[-1] if len(ends) else 0), np.repeat(overlap, children)
        return found


def _meet(rows: pa.Table, percent: int, least: int, whole: bool) -> pa.Table:
    """The pairs (a, b, linked) of each meeting's probes and sets that are ``least`` percent similar: linked if ``percent``.

    With ``whole`` all of them; otherwise links between components alone, as few as join them.
    """
    meetings: dict[int, tuple[list, list]] = {}
    for meeting, probe, *row in zip(*(rows.column(c).to_pylist() for c in ("meeting", "probe", "fp", "root", "keys")), strict=True):
        meetings.setdefault(meeting, ([], []))[probe].append(row)
    out = []
    for sets, probes in meetings.values():
        number: dict[bytes, int] = {}
        marks = np.array([number.setdefault(root or fp, len(number)) for fp, root, _ in sets], np.int64)
        own = [number.setdefault(root or fp, len(number)) for fp, root, _ in probes]
        joined = np.arange(len(number))
        arrays = [np.frombuffer(keys, np.uint64) for _, _, keys in sets]
        tree = PrefixTree(arrays, None if whole else marks)
        for (fp, _, keys), mine in zip(probes, own, strict=True):
            probe = np.frombuffer(keys, np.uint64)
            for k, overlap in tree.similar(probe, least) if whole else tree.similar(probe, percent, joined, joined[mine]):
                linked = 100 * overlap >= percent * (len(probe) + len(arrays[k]) - overlap)
                if whole or joined[marks[k]] != joined[mine]:
                    out.append((fp, sets[k][0], linked))
                    if not whole:
                        joined[joined == joined[marks[k]]] = joined[mine]
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.bool_()))], names=["a", "b", "linked"])


def met(meetings: DataFrame, keys: int, percent: int, least: int, whole: bool) -> DataFrame:
    """Hold all ``meetings``: rows (meeting, probe, fp, root, keys), of about so many ``keys``."""
    task = F.pmod("meeting", F.lit(keys // BLOCK_KEYS + 16)).cast("int")
    return meetings.withColumn("task", task).groupBy("task").applyInArrow(lambda t: _meet(t, percent, least, whole), "a binary, b binary, linked boolean")


def partners(pairs: DataFrame, size_b: str) -> DataFrame:
    """A meeting for each class ``a`` of ``pairs`` and about BLOCK classes or BLOCK_KEYS keys of its partners ``b``."""
    crowd = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size_b) / BLOCK_KEYS)).alias("parts"))
    parted = pairs.join(crowd, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("meeting"))
    probes = parted.select("meeting", F.lit(True).alias("probe"), F.col("a").alias("fp")).distinct()
    return probes.unionByName(parted.select("meeting", F.lit(False).alias("probe"), F.col("b").alias("fp")))


def blocks(members: DataFrame) -> DataFrame:
    """Meetings within families, from (fp, n, family, root): blocks of classes outside the family's largest component with blocks of all its classes."""
    of_root = members.groupBy("family", "root").agg(F.count("*").alias("held"), F.sum("n").alias("keys"))
    enough = lambda held, keys: F.greatest(F.ceil(held / BLOCK), F.ceil(keys / BLOCK_KEYS)).cast("int")
    largest = F.max(F.struct("held", "keys", "root"))
    of_family = of_root.groupBy("family").agg(largest.alias("most"), F.sum("held").alias("held"), F.sum("keys").alias("keys"), F.count("*").alias("roots")).filter("roots > 1").select(
        "family", F.col("most.root").alias("main"), enough(F.col("held"), F.col("keys")).alias("sets"),
        enough(F.col("held") - F.col("most.held"), F.col("keys") - F.col("most.keys")).alias("probes"),
    )
    inside = members.join(of_family, "family")
    meeting = lambda i, j: F.xxhash64("family", i, j).alias("meeting")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int").alias("block")
    sets = inside.select("family", "fp", block("sets"), every("probes", "other")).select(meeting("other", "block"), F.lit(False).alias("probe"), "fp")
    probes = inside.filter("root <> main").select("family", "fp", block("probes"), every("sets", "other")).select(meeting("block", "other"), F.lit(True).alias("probe"), "fp")
    return sets.unionByName(probes)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Classes of documents whose sets of word n-grams are linked by Jaccard similarities of ``percent`` or more.

    Returns (``id_col``, n_shingles, component_id), a row for each input row; ids have to be whole numbers. Null, empty and blank
    texts have no shingles, and are linked with nothing. Rows with one id are one document if their texts have links in common
    or are equal; a row without id passes its links on, and has a component of the ids that it reaches, or null.
    Other columns are not read. An empty table gives an empty result. ``percent`` is over FAMILY.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    survey = materialize(source.mapInArrow(lambda b: released(_survey(b, width)), "id long, n long, fp binary, keys array<long>, held array<long>"), "ngram-survey", "zstd")
    rows = survey.filter("keys is null").select("id", "n", "fp")
    several = survey.filter("keys is not null")
    counts = several.select(F.explode(F.arrays_zip("keys", "held")).alias("k")).groupBy("k.keys").agg(F.sum("k.held").alias("held")).filter(F.col("held") >= COMMON_FROM)
    often = counts.orderBy(F.desc("held"), "keys").limit(COMMON).select("keys").toArrow()  # COMMON numbers at most
    common = np.sort(often.column(0).to_numpy().astype(np.uint64))
    shipped = spark.sparkContext.broadcast(common)
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    steps = fans(total * (100 - percent) // 100 // RANGE_KEYS + 32)
    prefixes = source.select("text").mapInArrow(lambda b: released(_prefixes(b, shipped.value, steps[0], width, percent)), _MESSAGE)
    messages = dealt(prefixes, steps, several.count())
    shared = materialize(messages.groupBy("range").applyInArrow(lambda t: _shared(t, percent), _SHARED), "ngram-shared", "zstd")
    counted = shared.filter("tokens is null").select("range", "a", "b", "size_a", "size_b", "keys", "large")
    classes = materialize(rows.filter("n > 0").groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n")), "ngram-classes")

    def links_of(meetings: DataFrame, least: int, whole: bool) -> DataFrame:
        """Hold ``meetings`` (meeting, probe, fp, root). A class' set is made from the row with its least id (or all without one)."""
        nodes = materialize(meetings.groupBy("fp").agg(F.count("*").alias("times")).join(classes, "fp"), "ngram-nodes")
        held, keys = nodes.agg(F.count("*"), F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0))).first()
        named = "id long, fp binary, keys binary"
        if held <= FILTER_CLASSES:
            size = 1 << max(16, (64 * held).bit_length())
            bit = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(size))).alias("bit")
            bits = nodes.select(bit("least")).groupBy((F.col("bit") / 8).cast("long").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits")).toArrow()
            wanted = np.zeros(size // 8, np.uint8)
            wanted[bits.column("byte").to_numpy()] = bits.column("bits").to_numpy()
            filtered = spark.sparkContext.broadcast(wanted)
            sets = source.select("id", "text", bit("id")).mapInArrow(lambda b: released(_sets(b, filtered.value, shipped.value, width)), named)
        else:
            own = nodes.select(F.col("least").alias("own")).distinct()
            texts = source.join(own, F.col("id").eqNullSafe(F.col("own")), "left_semi").select("id", "text", F.lit(0).cast("long").alias("bit"))
            sets = texts.mapInArrow(lambda b: released(_sets(b, None, shipped.value, width)), named)
        # all by class: the sets are shuffled once for these joins, and once to the tasks that hold the meetings
        sets = sets.join(nodes.select("fp", "least"), "fp").filter(F.col("id").eqNullSafe(F.col("least"))).dropDuplicates(["fp"]).select("fp", "keys")
        found = materialize(met(meetings.join(sets, "fp"), keys, percent, least, whole), "ngram-links")
        discard(nodes, meetings)
        if held <= FILTER_CLASSES:
            filtered.destroy()
        return found

    summed = materialize(counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("keys").alias("keys"), F.max("large").alias("large")), "ngram-counted")
    # each class with the one before it by name that it shares most keys with: as many pairs as classes, and most families are one component then
    best = lambda df: df.groupBy("b").agg(F.max_by(F.struct("a", "size_b"), F.struct("keys", "a")).alias("x")).select("x.a", "b", "x.size_b")
    first = materialize(best(summed.filter(enough_keys(percent))).union(best(summed.filter("large"))).distinct(), "ngram-first")
    unrooted = materialize(partners(first, "size_b").withColumn("root", F.lit(None).cast("binary")), "ngram-rows")
    discard(summed, first)
    near = links_of(unrooted, FAMILY, True)
    roots = materialize(connected_components(near.filter("linked")), "ngram-roots")
    families = materialize(connected_components(near).select(F.col("node").alias("fp"), F.col("root").alias("family")), "ngram-families")

    sides = counted.select("range", F.explode(F.array("a", "b")).alias("fp")).distinct()
    blank = lambda names: [F.lit(None).cast("binary").alias(c) for c in names]
    named = sides.join(families, "fp").select("range", "fp", "family", *blank(["tokens", "nodes", "fps", "sizes"]))
    arrays = shared.filter("tokens is not null").select("range", *blank(["fp", "family"]), "tokens", "nodes", "fps", "sizes")
    crossed = named.unionByName(arrays).groupBy("range").applyInArrow(lambda t: _across(t, percent), "a binary, b binary, size_a long, size_b long, keys long")
    crossed = materialize(crossed.groupBy("a", "b", "size_a", "size_b").agg(F.sum("keys").alias("keys")).filter(enough_keys(percent)).select("a", "b", "size_b"), "ngram-crossed")
    discard(shared)
    root = roots.select(F.col("node").alias("fp"), "root")
    members = families.join(classes.select("fp", "n"), "fp").join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    meetings = materialize(blocks(materialize(members, "ngram-members")).unionByName(partners(crossed, "size_b")).join(root, "fp", "left"), "ngram-rows")
    across = links_of(meetings, percent, False)
    shipped.destroy()
    roots = materialize(connected_components(near.filter("linked").select("a", "b").unionByName(across.select("a", "b"))), "ngram-roots")
    discard(near, across)

    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "ngram-named")
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "ngram-least")
    of_class = materialize(named.join(least, "root").select("fp", "component_id"), "ngram-components")
    joined = rows.join(of_class, "fp", "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
