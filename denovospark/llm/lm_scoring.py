"""Operator 2: language-model scores by deleted interpolation.

The model mixes maximum-likelihood bigram and unigram estimates with a uniform one,

    P(w | h) = a2[b] c(h, w) / c(h) + a1[b] c(w) / N + a0[b] / (V + 1),      b = the bucket of c(h),

with weights for each bucket of context frequencies, found by expectation-maximisation: the counts of all training folds but
one are the estimates, the fold that is deleted from them gives the held-out counts. The scores use the counts of all folds.

Documents are turned once into blocks of about BLOCK tokens with a vocabulary of their own. A block asks for the counts of
its distinct tokens and bigrams: sorted 64-bit keys with the block's own counts, shuffled as arrays by ranges of the key. Each
range adds up and answers every block in the order of its question, so that neither texts nor tokens meet the counts in a
row-by-row join, a frequent token costs no more than a rare one (once per block), and no vocabulary is ever in one place.
A block asks FAN ranges at most. Where more are needed, the questions of FAN blocks to one range are added up, and asked of its parts
as one; so the number of messages grows with the data and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, id_fold, lower_words, materialize, mix, pack, released, unpack

BLOCK = 1_000_000
#: Blocks whose keys a range holds, about, and ranges that one block asks.
BLOCKS_PER_RANGE, FAN = 2, 256
#: Context counts 0, 1, 2-3, 4-7, ...
BUCKETS = 32
#: Held-out counts are added up by estimates rounded to so many steps an octave; NONE stands for an estimate of 0.
STEPS, NONE = 16, 1
TOKENS, PAIRS = 0, 1


class _Vocabulary(dict):
    """Word -> its number; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType, size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    task, n = TaskContext.get().partitionId(), 0
    ids: list = []
    folds: list[int] = []
    tokens: list[np.ndarray] = []
    vocabulary, held = _Vocabulary(), 0

    def block() -> pa.RecordBatch:
        keys = np.array([0, *map(xxhash.xxh3_64_intdigest, vocabulary)], np.uint64)
        values = [
            [(task << 32) + n], [ids], [np.array(folds, np.int8).tobytes()], [np.array([len(t) for t in tokens], np.int64).tobytes()],
            [pack(np.concatenate(tokens).astype(np.int32))], [keys.tobytes()],
        ]
        kinds = [pa.int64(), pa.list_(kind), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "ids", "folds", "lengths", "tokens", "keys"])

    for batch in batches:
        for key, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = lower_words(text.as_py())
            ids.append(key)
            folds.append(fold)
            tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            tokens[-1] = np.append(tokens[-1], np.int32(0))
            held += len(tokens[-1])
            if held >= size:
                yield block()
                n += 1
                ids, folds, tokens, vocabulary, held = [], [], [], _Vocabulary(), 0
    if ids:
        yield block()


class Block:
    """The arrays of a block, and its distinct tokens and bigrams in the order of their keys."""

    def __init__(self, row: dict) -> None:
        self.folds, self.lengths = np.frombuffer(row["folds"], np.int8), np.frombuffer(row["lengths"], np.int64)
        self.tokens, own = unpack(row["tokens"], np.int32), np.frombuffer(row["keys"], np.uint64)
        self.order = np.argsort(own, kind="stable")  # of the vocabulary, by key
        self.token_keys = own[self.order]
        self.place = np.empty(len(own), np.int64)
        self.place[self.order] = np.arange(len(own))
        ends = np.cumsum(self.lengths)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.append(0, ends[:-1])] = 0  # the first word of a text follows an end
        pairs, self.pair_of = np.unique(before.astype(np.int64) << 32 | self.tokens, return_inverse=True)
        first, second = pairs >> 32, pairs & 0xFFFFFFFF
        keys = mix(mix(own[first] + np.uint64(0x1F83D9ABFB41BD6B)) + own[second])
        by_key = np.argsort(keys, kind="stable")
        turn = np.empty(len(keys), np.int64)
        turn[by_key] = np.arange(len(keys))
        self.pair_of, self.pair_keys = turn[self.pair_of], keys[by_key]
        self.first, self.second = self.place[first[by_key]], self.place[second[by_key]]  # as places among the tokens
        self.starts = np.append(0, ends[:-1])
        self.fold_of = np.repeat(self.folds, self.lengths)

    def counts(self, which: int, mask: np.ndarray) -> np.ndarray:
        at = self.place[self.tokens[mask]] if which == TOKENS else self.pair_of[mask]
        return np.bincount(at, minlength=len(self.token_keys if which == TOKENS else self.pair_keys)).astype(np.int64)


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for k in range(table.num_rows):
        yield {name: table.column(name)[k].as_py() for name in table.schema.names}


_QUESTION = "range int, block long, keys binary, rest binary, deleted binary"
_ANSWER = "range int, block long, rest binary, whole binary, n_rest long, n_whole long"


def _parted(which: int, part: int, parts: int, cut: int, block: int, keys: np.ndarray, rest: np.ndarray, deleted: np.ndarray) -> list[tuple]:
    """Questions to the ``cut`` parts of ``part``, one of ``parts`` equal ranges of the keys."""
    low, high = (part << 64) // parts, ((part + 1) << 64) // parts
    edges = np.array([low + (high - low) * k // cut for k in range(1, cut)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    slices = ((k, slice(cuts[k], cuts[k + 1])) for k in range(cut) if cuts[k] < cuts[k + 1])
    return [(2 * (part * cut + k) + which, block, keys[s].tobytes(), pack(rest[s]), pack(deleted[s])) for k, s in slices]


def _questions(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=["range", "block", "keys", "rest", "deleted"])


def _ask(batches: Iterator[pa.RecordBatch], cut: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            block, out = Block(row), []
            for which, keys in ((TOKENS, block.token_keys), (PAIRS, block.pair_keys)):
                out += _parted(which, 0, 1, cut, row["block"], keys, block.counts(which, block.fold_of > 1), block.counts(which, block.fold_of == 1))
            yield _questions(out)


def _gather(table: pa.Table, groups: int) -> pa.Table:
    """The questions of a group of blocks to one range as one: distinct keys with added counts, and where each block's keys are among them."""
    asked = list(_rows(table))
    keys, at = np.unique(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in asked]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([unpack(r[c], np.int64) for r in asked]), len(keys)).astype(np.int64) for c in ("rest", "deleted")]
    sizes = [len(r["keys"]) // 8 for r in asked]
    values = [asked[0]["range"], asked[0]["range"] * groups + asked[0]["group"], keys.tobytes(), *map(pack, sums), [r["block"] for r in asked], sizes, pack(at.astype(np.int32))]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["range", "block", "keys", "rest", "deleted", "members", "sizes", "places"])


def _ask_again(batches: Iterator[pa.RecordBatch], parts: int, cut: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            part, which = divmod(row["range"], 2)
            yield _questions(_parted(which, part, parts, cut, row["block"], np.frombuffer(row["keys"], np.uint64), unpack(row["rest"], np.int64), unpack(row["deleted"], np.int64)))


def _spread(gathered: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers to a question that was asked for several blocks, one for each of them."""
    out: list[tuple] = []
    for row in _rows(gathered):
        heard = sorted(_rows(answers), key=lambda r: r["range"])
        rest, whole = (np.concatenate([unpack(r[c], np.int64) for r in heard]) for c in ("rest", "whole"))
        places, begin = unpack(row["places"], np.int32), 0
        new = [sum(r[c] for r in heard) for c in ("n_rest", "n_whole")]
        for k, (block, size) in enumerate(zip(row["members"], row["sizes"], strict=True)):
            own = places[begin : begin + size]
            out.append((row["range"], block, pack(rest[own]), pack(whole[own]), *(new if k == 0 else (0, 0))))
            begin += size
    return _answers(out)


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=["range", "block", "rest", "whole", "n_rest", "n_whole"])


def _answer(table: pa.Table) -> pa.Table:
    """Add up one range, and answer each block: counts without and with the deleted fold. The first answer has the distinct keys."""
    asked = list(_rows(table))
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in asked])
    distinct, at = np.unique(keys, return_inverse=True)
    sums = {c: np.bincount(at, np.concatenate([unpack(r[c], np.int64) for r in asked]), len(distinct)).astype(np.int64) for c in ("rest", "deleted")}
    whole = sums["rest"] + sums["deleted"]
    rest_at, whole_at, begin, out = sums["rest"][at], whole[at], 0, []
    for k, r in enumerate(asked):
        end = begin + len(r["keys"]) // 8
        new = [int((sums["rest"] > 0).sum()), int((whole > 0).sum())] if k == 0 else [0, 0]
        out.append((r["range"], r["block"], pack(rest_at[begin:end]), pack(whole_at[begin:end]), *new))
        begin = end
    return _answers(out)


def answered(asked: DataFrame, blocks: int, ranges: int, parts: int) -> DataFrame:
    """Answers (_ANSWER) to the questions of ``blocks`` blocks, which are cut into ``parts`` ranges; to be added up in ``ranges`` or a few more."""
    if parts >= ranges:
        return materialize(asked.groupBy("range").applyInArrow(_answer, _ANSWER), "lm-answers", "zstd")
    groups, cut = -(-blocks // FAN), min(FAN, -(-ranges // parts))
    grouped = asked.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("range", "group")
    gathered = grouped.applyInArrow(lambda t: _gather(t, groups), _QUESTION + ", members array<long>, sizes array<long>, places binary")
    gathered = materialize(gathered, "lm-gathered", "zstd")
    finer = gathered.select("range", "block", "keys", "rest", "deleted").mapInArrow(lambda b: released(_ask_again(b, parts, cut)), _QUESTION)
    heard = answered(finer, groups, ranges, parts * cut)
    own = gathered.select("range", "block", "members", "sizes", "places").groupBy("block")
    spread = materialize(own.cogroup(heard.groupBy("block")).applyInArrow(_spread, _ANSWER), "lm-answers", "zstd")
    discard(gathered, heard)
    return spread


def _heard(answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's tokens and bigrams, in the order of their keys."""
    parts: tuple[list, list] = ([], [])
    for r in sorted(_rows(answers.select(["range", column])), key=lambda r: r["range"]):
        parts[r["range"] % 2].append(unpack(r[column], np.int64))
    return np.concatenate(parts[TOKENS]), np.concatenate(parts[PAIRS])


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _rounded(estimate: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(estimate > 0, np.rint(STEPS * np.log2(estimate)), NONE)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens of each block, without and with the deleted fold."""
    for batch in batches:
        out = []
        for row in _rows(batch):
            folds, lengths = np.frombuffer(row["folds"], np.int8), np.frombuffer(row["lengths"], np.int64)
            out.append((int(lengths[folds > 1].sum()), int(lengths[folds > 0].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["n_rest", "n"])


def _deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deleted fold's bigrams of each block: places of both tokens and of the bigram in the block's question, and how many."""
    for batch in batches:
        for row in _rows(batch):
            block = Block(row)
            n = block.counts(PAIRS, block.fold_of == 1)
            here = np.flatnonzero(n)
            values = [row["block"], *(x.astype(np.int32).tobytes() for x in (block.first[here], block.second[here], here, n[here]))]
            kinds = [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "first", "second", "pair", "n"])


def _held_out(deleted: pa.Table, answers: pa.Table, n_rest: int) -> pa.Table:
    """The deleted fold's tokens of a block, counted by context bucket and rounded estimates."""
    out: list[tuple[int, ...]] = []
    if deleted.num_rows:
        tokens, pairs = _heard(answers, "rest")
        for row in _rows(deleted):
            first, second, pair, n = (np.frombuffer(row[c], np.int32) for c in ("first", "second", "pair", "n"))
            if len(n):
                context, single = tokens[first], tokens[second]
                code = np.stack([bucket_of(context), _rounded(pairs[pair] / np.maximum(context, 1)), _rounded(single / max(n_rest, 1))], 1).astype(np.int64)
                kinds, at = np.unique(code, axis=0, return_inverse=True)
                out += [(*map(int, k), int(c)) for k, c in zip(kinds, np.bincount(at.ravel(), n), strict=True)]
    return pa.table([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["bucket", "pair", "single", "n"])


def expectation_maximisation(counts: list[tuple[int, int, int, int]], vocabulary: int, rounds: int = 60) -> np.ndarray:
    """BUCKETS x 3 weights (bigram, unigram, uniform) from rows (bucket, rounded bigram and unigram estimates, tokens)."""
    start = np.array([0.4, 0.5, 0.1])
    weights = np.tile(start, (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]  # a context never seen has no bigram estimate
    table = np.array(counts, float).reshape(-1, 4)
    for b in range(BUCKETS):
        rows = table[table[:, 0] == b]
        if not len(rows):
            continue
        f = np.column_stack([*(np.where(rows[:, k] == NONE, 0, 2.0 ** (rows[:, k] / STEPS)) for k in (1, 2)), np.full(len(rows), 1 / (vocabulary + 1))])
        a = weights[b]
        for _ in range(rounds):
            share = a * f
            share /= share.sum(1, keepdims=True)
            a = share.T @ rows[:, 3] + (start if b else weights[0])  # one token's worth of the start keeps every weight above 0
            a /= a.sum()
        weights[b] = a
    return weights


def _weights(counts: pa.Table, vocabulary: int) -> pa.Table:
    """The weights of one bucket."""
    rows = list(zip(*(counts.column(c).to_pylist() for c in ("bucket", "pair", "single", "n")), strict=True))
    b = rows[0][0]
    return pa.table([pa.array([x]) for x in (b, *map(float, expectation_maximisation(rows, vocabulary)[b]))], names=["bucket", "a2", "a1", "a0"])


def _score(blocks: pa.Table, answers: pa.Table, weights: np.ndarray, n: int, v: int, kind: pa.DataType) -> pa.Table:
    tokens, pairs = _heard(answers, "whole")
    out: list[pa.Table] = []
    for row in _rows(blocks):
        block = Block(row)
        context, single = tokens[block.first], tokens[block.second]
        a = weights[bucket_of(context)]
        with np.errstate(divide="ignore"):
            said = np.log10(a[:, 0] * pairs / np.maximum(context, 1) + a[:, 1] * single / max(n, 1) + a[:, 2] / (v + 1))
            base = np.log10((single + 0.1) / (n + 0.1 * (v + 1)))
        add = lambda x, b=block: np.add.reduceat(x[b.pair_of], b.starts)
        columns = [pa.array(row["ids"], kind), pa.array(block.folds == 0), pa.array(block.lengths), pa.array(add((single > 0).astype(np.int64))), pa.array(np.full(len(block.lengths), n)), pa.array(add(base)), pa.array(add(said))]
        out.append(pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
    return pa.concat_tables(out)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, block: int = BLOCK) -> DataFrame:
    """log10 probabilities of all whole texts under a model of the texts whose crc32(id as text) mod ``folds`` isn't 0.

    Returns (``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score). Null and empty texts are an end alone; a
    null id is in the last fold; repeated rows are learnt from and scored as often as they occur. Without training texts all
    probability is uniform. An empty table gives an empty result. Other columns are not read. Blocks and answers are tables in
    the shared folder; fold 1 is the one that is deleted from the counts to fit the weights.
    """
    kind, arrow = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    fold = F.coalesce(id_fold(F.col(id_col), folds), F.lit(folds - 1)).cast("int").alias("fold")
    source = docs.select(F.col(id_col).alias("id"), fold, F.col(text_col).alias("text"))
    schema = f"block long, ids array<{kind}>, folds binary, lengths binary, tokens binary, keys binary"
    blocks = materialize(source.mapInArrow(lambda b: released(_blocks(b, arrow, block)), schema), "lm-blocks", "zstd")
    held = blocks.count()
    ranges = held // BLOCKS_PER_RANGE + 8
    parts = min(ranges, FAN)
    answers = answered(blocks.mapInArrow(lambda b: released(_ask(b, parts)), _QUESTION), held, ranges, parts)
    none = F.lit(0)
    v_rest, v = answers.filter(F.col("range") % 2 == TOKENS).agg(F.coalesce(F.sum("n_rest"), none), F.coalesce(F.sum("n_whole"), none)).first()
    n_rest, n = blocks.select("folds", "lengths").mapInArrow(_totals, "n_rest long, n long").agg(F.coalesce(F.sum("n_rest"), none), F.coalesce(F.sum("n"), none)).first()
    heard = answers.select("range", "block", "rest", "whole")
    deleted = blocks.mapInArrow(lambda b: released(_deleted(b)), "block long, first binary, second binary, pair binary, n binary")
    held_out = deleted.groupBy("block").cogroup(heard.drop("whole").groupBy("block")).applyInArrow(lambda a, b: _held_out(a, b, n_rest), "bucket long, pair long, single long, n long")
    counts = held_out.groupBy("bucket", "pair", "single").agg(F.sum("n").alias("n"))
    fitted = counts.groupBy("bucket").applyInArrow(lambda t: _weights(t, v_rest), "bucket long, a2 double, a1 double, a0 double").collect()  # BUCKETS rows at most
    weights = expectation_maximisation([], v_rest)
    for r in fitted:
        weights[r["bucket"]] = [r["a2"], r["a1"], r["a0"]]
    scored = blocks.groupBy("block").cogroup(heard.drop("rest").groupBy("block")).applyInArrow(
        lambda a, b: _score(a, b, weights, n, v, arrow), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumnRenamed("id", id_col)
