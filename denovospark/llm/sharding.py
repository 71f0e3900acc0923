"""Operator 3: shards by balanced label propagation, in DataFrame operations alone.

Documents that share a link value (for the query: the same text) should lie in the same shard, and all shards should have
as many rows as the others, or one more. Links aren't expanded into pairs: a link value is a hub, and a round counts each
hub's members by shard, sums the counts of a row's hubs, and lets the row ask for the shard with most of its neighbours.
What moves is limited by quotas: requests pass as far as they form swaps and longer cycles between shards, or a shard has room
left. Exactly as many rows move as the quota says, those of a hub together where they can. Rows without links have no edges to cut; they are dealt last, to exactly the room that is left, so the law holds
after any number of rounds, and whatever the links are: a hub larger than a shard fills one and overflows.

Only tables of at most shards x shards x BUCKETS rows come to the driver. Ranks are made of counts by bucket and of ranks
within a bucket, so no task gets a whole shard.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Requests pass in buckets, those of a hub mostly together: (hub, row) hashes.
HUB_BUCKETS, ROW_BUCKETS = 64, 8
BUCKETS = HUB_BUCKETS * ROW_BUCKETS
#: Rows that a bucket of a rank holds, about.
RANK_ROWS = 20_000


def ranked(df: DataFrame, group: list[str], key: Column, rows: int, name: str) -> DataFrame:
    """Add the gapless rank from 0 of each row within its group (all rows, if no group), by the hash of ``key``."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(rows // RANK_ROWS + 16)))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(F.xxhash64(key), key))
    return df.withColumn("_rank", within).join(starts, [*group, "_bucket"]).withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_bucket", "_rank", "_start")


def _cycle(left: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Some cycle of shards with requests left along all of it, the shortest from its first shard; empty if there is none."""
    onward: dict[int, list[int]] = defaultdict(list)
    for (s, t), n in sorted(left.items()):
        if n > 0 and s != t:
            onward[s].append(t)
    for first in sorted(onward):
        came = {first: first}
        queue = [first]
        for s in queue:
            for t in onward[s]:
                if t == first:
                    ways = [(s, t)]
                    while s != first:
                        ways.append((came[s], s))
                        s = came[s]
                    return ways
                if t not in came:
                    came[t] = s
                    queue.append(t)
    return []


def grant(asked: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the requests from s to t pass: swaps, then what there is room for, then longer cycles."""
    passed = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
    room, moved = list(room), True
    while moved:
        moved = False
        for (s, t), n in sorted(asked.items()):
            more = min(n - passed[s, t], room[t])
            if more > 0:
                passed[s, t] += more
                room[t] -= more
                room[s] += more
                moved = True
    left = {way: n - passed[way] for way, n in asked.items()}
    while ways := _cycle(left):
        most = min(left[w] for w in ways)
        for w in ways:
            left[w] -= most
            passed[w] += most
    return passed


def _votes(links: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(row, c0.., first hub): for each linked row, how many members its hubs have in each shard, itself included."""
    names = [f"c{k}" for k in range(shards)]
    held = links.join(labels, "row").groupBy("hub").agg(*(F.count(F.when(F.col("shard") == k, 1)).alias(n) for k, n in enumerate(names)))
    held = materialize(held, "shard-hubs")  # read back, so that the join below can split a hub with very many members
    return links.join(held, "hub").groupBy("row").agg(*(F.sum(n).alias(n) for n in names), F.min("hub").alias("first"))


def propagate(links: DataFrame, capacity: list[int], rounds: int) -> tuple[DataFrame, list[int]]:
    """Labels (row, shard) of the linked rows after at most ``rounds`` rounds, and how many each shard has of them."""
    shards = len(capacity)
    rows = materialize(links.select("row").distinct(), "shard-rows")
    total = rows.count()
    start = ranked(rows, [], F.col("row"), total, "at")
    # the first labels fill every shard in proportion to its capacity
    ends = [total * sum(capacity[: k + 1]) // max(1, sum(capacity)) for k in range(shards)]
    first = sum(((F.col("at") >= end).cast("int") for end in ends[:-1]), F.lit(0))
    labels = materialize(start.select("row", first.cast("int").alias("shard")), "shard-labels")
    held = [end - begin for begin, end in zip([0, *ends], ends, strict=False)]
    quota = "shard int, to int, last int, rest long"
    for turn in range(rounds):
        # ties go another way each round, so that what is left over can swap later
        best = F.array_max(F.array(*(F.struct(F.col(f"c{k}").alias("n"), (-F.pmod(F.xxhash64("first", F.lit(turn)) + k, F.lit(shards))).alias("turn"), F.lit(k).alias("k")) for k in range(shards))))["k"]
        bucket = F.pmod(F.xxhash64("first"), F.lit(HUB_BUCKETS)) * ROW_BUCKETS + F.pmod(F.xxhash64("row"), F.lit(ROW_BUCKETS))
        asks = materialize(_votes(links, labels, shards).join(labels, "row").select("row", "shard", best.alias("to"), bucket.cast("int").alias("bucket")), "shard-asks")
        counts = asks.filter("shard <> to").groupBy("shard", "to", "bucket").count().collect()  # shards x shards x BUCKETS at most
        asked: dict[tuple[int, int], int] = defaultdict(int)
        for r in counts:
            asked[r["shard"], r["to"]] += r["count"]
        if not asked:
            break
        passed = grant(asked, [c - h for c, h in zip(capacity, held, strict=True)])
        # whole buckets pass in order, and of the first that doesn't as many rows as the quota leaves
        last, rest = {}, dict(passed)
        for r in sorted(counts, key=lambda r: r["bucket"]):
            way = r["shard"], r["to"]
            if way not in last:
                if r["count"] <= rest[way]:
                    rest[way] -= r["count"]
                else:
                    last[way] = r["bucket"]
        for (s, t), n in passed.items():
            held[s] -= n
            held[t] += n
        ways = links.sparkSession.createDataFrame([(s, t, last.get((s, t), BUCKETS), rest[s, t]) for s, t in asked], quota)
        told = asks.join(F.broadcast(ways), ["shard", "to"], "left")  # shards x shards rows
        edge = F.col("bucket").eqNullSafe(F.col("last"))
        clear = told.filter(~edge).select("row", F.when(F.col("bucket") < F.col("last"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        cut = ranked(told.filter(edge), ["shard", "to"], F.col("row"), total // BUCKETS, "at").select("row", F.when(F.col("at") < F.col("rest"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        labels = materialize(clear.unionByName(cut), "shard-labels")
    return labels, held


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = 6) -> DataFrame:
    """Deal all rows to ``shards`` shards whose row counts differ by one at most, equal texts together where that allows.

    Returns (``id_col``, size, text_crc32, law, shard, slot, grown_shard, linked). A null text has size 1 and the checksum of
    the empty text, and is linked with nothing; empty texts equal each other. Null and repeated ids are rows as others. An
    empty table gives an empty result. Other columns are not read. Texts are read once and not shuffled.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), text.isNull().alias("blank"), F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(base, "shard-base")
    same = ["h", "text_crc32", "size"]
    hubs = materialize(base.filter("not blank").groupBy(*same).agg(F.min("row").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n"), "shard-groups")
    links = materialize(base.filter("not blank").join(hubs, same).select("row", "hub"), "shard-links")
    n = base.count()
    capacity = [n // shards + (k < n % shards) for k in range(shards)]
    labels, held = propagate(links, capacity, rounds)
    loose = materialize(base.select("row").join(labels, "row", "left_anti"), "shard-loose")
    room, ends = [c - h for c, h in zip(capacity, held, strict=True)], []
    for r in room:
        ends.append(r + (ends[-1] if ends else 0))
    dealt = sum(((F.col("at") >= end).cast("int") for end in ends[:-1]), F.lit(0)).cast("int")
    filled = ranked(loose, [], F.col("row"), n, "at").select("row", dealt.alias("shard"), F.lit(False).alias("linked"))
    placed = materialize(filled.unionByName(labels.withColumn("linked", F.lit(True))), "shard-placed")
    return ranked(placed, ["shard"], F.col("row"), n // shards, "slot").join(base, "row").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked"
    )
