import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from denovospark.llm import sharding


def held(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(shards)) and max(counts.values()) - min(counts[k] for k in range(shards)) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k]))


def split(rows):
    places = defaultdict(Counter)
    for r in rows:
        places[r.text_crc32, r.size][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in places.values())


def test_law_and_groups(spark):
    texts = [f"single {i}" for i in range(900)] + [f"group {i % 60}" for i in range(300)] + [None] * 5 + [""] * 3
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, "single 1", "x"), (None, "null id", "x")], "doc_id long, text string, shard string")
    rows = sharding.shard_documents(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    held(rows, 8)
    for r in rows:
        if r.doc_id is not None and r.doc_id != 1:
            text = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert split([r for r in rows if r.linked]) == 0


def test_a_group_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else str(i)) for i in range(600)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=4).collect()
    held(rows, 4)
    assert split(rows) <= 400 - 150 + 20


def test_all_in_pairs(spark):
    docs = spark.createDataFrame([(i, str(i // 2)) for i in range(401)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=4, rounds=8).collect()
    held(rows, 4)
    assert split(rows) < 40  # of 200 pairs; a random deal splits 150


@pytest.mark.parametrize(("pairs", "shards", "loose"), [(2000, 8, 0), (2000, 4, 0), (2000, 8, 400)])
def test_full_shards_still_swap(spark, pairs, shards, loose):
    """Where no shard has room, a random deal splits seven pairs of eight."""
    docs = spark.range(2 * pairs + loose).selectExpr("id as doc_id", f"if(id < {2 * pairs}, concat('pair ', id div 2), concat('loose ', id)) as text")
    rows = sharding.shard_documents(docs, shards=shards).collect()
    held(rows, shards)
    assert split(rows) < 0.05 * pairs


def hash64(*values):
    """Spark's xxhash64 of whole numbers of 64 bits, as chained hashes of 8 bytes."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(struct.pack("<q", v) if isinstance(v, Long) else struct.pack("<i", v), seed=seed & (2**64 - 1)).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


class Long(int):
    pass


def brute(links, capacity, rounds):
    """Labels by definition, in plain Python: links are (row, hub)."""
    shards = len(capacity)
    rows = sorted({r for r, _ in links})
    total = len(rows)
    rank = lambda xs, n: sorted(xs, key=lambda r: (hash64(Long(r)) % (n // sharding.RANK_ROWS + 16), hash64(Long(r)), r))
    ends = [total * sum(capacity[: k + 1]) // sum(capacity) for k in range(shards)]
    label = {r: sum(at >= e for e in ends[:-1]) for at, r in enumerate(rank(rows, total))}
    hubs, members = defaultdict(list), defaultdict(list)
    for r, h in links:
        hubs[r].append(h)
        members[h].append(r)
    for turn in range(rounds):
        count = {h: Counter(label[r] for r in rs) for h, rs in members.items()}
        asks = {}
        for r in rows:
            first = Long(min(hubs[r]))
            votes = [sum(count[h][k] for h in hubs[r]) for k in range(shards)]
            to = max(range(shards), key=lambda k: (votes[k], -((hash64(first, turn) + k) % shards), k))
            asks[r] = to, hash64(first) % sharding.HUB_BUCKETS * sharding.ROW_BUCKETS + hash64(Long(r)) % sharding.ROW_BUCKETS
        ways = defaultdict(list)
        for r, (to, bucket) in asks.items():
            if to != label[r]:
                ways[label[r], to].append((bucket, r))
        if not ways:
            break
        held = Counter(label.values())
        passed = sharding.grant({w: len(x) for w, x in ways.items()}, [c - held[k] for k, c in enumerate(capacity)])
        for way, asked in ways.items():
            order = {r: k for k, r in enumerate(rank([r for _, r in asked], total // sharding.BUCKETS))}
            for _, r in sorted(asked, key=lambda x: (x[0], order[x[1]]))[: passed[way]]:
                label[r] = way[1]
    return label


@pytest.mark.parametrize(("shards", "room"), [(4, 0), (3, 20)])
def test_labels_equal_brute_force(spark, shards, room):
    draw = random.Random(shards)
    links = [(r, draw.randrange(150)) for r in range(600)] + [(r, 1000 + r % 7) for r in range(0, 600, 5)] + [(r, 77) for r in range(0, 600, 3)]
    links = sorted(set(links))
    capacity = [600 // shards + room] * shards
    labels, held_by = sharding.propagate(spark.createDataFrame(links, "row long, hub long"), capacity, 5)
    got = {r.row: r.shard for r in labels.collect()}
    assert got == brute(links, capacity, 5)
    assert Counter(got.values()) == Counter({k: n for k, n in enumerate(held_by) if n}) and all(n <= c for n, c in zip(held_by, capacity, strict=True))


def test_quotas():
    assert sharding.grant({(0, 1): 5, (1, 2): 3, (2, 0): 4}, [0, 0, 0]) == {(0, 1): 3, (1, 2): 3, (2, 0): 3}
    assert sharding.grant({(0, 1): 5, (1, 2): 3}, [0, 0, 0]) == {(0, 1): 0, (1, 2): 0}
    assert sharding.grant({(0, 1): 5, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding.grant({(0, 1): 5, (1, 0): 3}, [0, 1]) == {(0, 1): 4, (1, 0): 3}


def test_empty(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
