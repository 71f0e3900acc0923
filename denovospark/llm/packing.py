"""Operator 13: vector bin packing of examples into training sequences.

A sequence has room for so many tokens, segments (pieces of examples) and loss-bearing tokens. Sequences are filled one at a time by
the dot-product heuristic: of the examples that fit, the next is the one whose demand, weighted by how scarce each dimension is, has the
greatest dot product with the room that is left. Where none fits, the longest example is cut to the room. A sequence that is full in another
dimension than tokens gives back what it holds beyond a power of two tokens, so that no sequence needs padding.

Each task packs the examples that it reads, a window of them at a time, and needs no shuffle. The rest of a task, less than a sequence, goes on
to a second round, with some thousand rests a task; only there tails are cut into powers of two. A task holds one window of ids; a row that is
larger than a window is cut into whole sequences at once.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released

#: Tokens and examples that a task chooses from at a time, and those that it keeps for the next window.
WINDOW_TOKENS, WINDOW_ITEMS, KEPT_TOKENS = 1 << 20, 1 << 14, 1 << 17
#: Sequences that are filled from one list of classes.
LISTED = 64
#: Words after which a worker begins anew to remember them, some 250 MB with their pieces.
MEMO_WORDS = 1 << 20
#: Bytes of texts that are encoded at once, unless one text has more.
GROUP_BYTES = 8 << 20
#: Where the second round's sequences are numbered from.
SECOND = 1 << 62
_COLUMNS = "start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary, mask binary"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("every limit has to be 1 at least")


@dataclass(frozen=True)
class Item:
    """A stretch of an example that isn't placed yet. ``mask`` is 1 at loss-bearing tokens; without one all are."""

    example: object
    start: int
    total: int
    ids: np.ndarray
    mask: np.ndarray | None

    @property
    def loss(self) -> int:
        return len(self.ids) if self.mask is None else int(self.mask.sum())

    def split(self, at: int) -> tuple[Item, Item]:
        cut = lambda x: (None, None) if x is None else (x[:at], x[at:])
        (a, b), (m, w) = cut(self.ids), cut(self.mask)
        return Item(self.example, self.start, self.total, a, m), Item(self.example, self.start + at, self.total, b, w)

    def within(self, tokens: int, loss: int) -> int:
        """The longest beginning that keeps to both."""
        most = min(tokens, len(self.ids))
        return min(most, loss) if self.mask is None else int(np.searchsorted(np.cumsum(self.mask[:most], dtype=np.int64), loss, "right"))


class Pool:
    """Items by demand: tokens and loss-bearing tokens."""

    def __init__(self, limits: Limits) -> None:
        self.limits, self.tokens, self.items = limits, 0, 0
        self.classes: dict[tuple[int, int], list[Item]] = defaultdict(list)

    def add(self, item: Item) -> None:
        self.classes[len(item.ids), item.loss].append(item)
        self.tokens += len(item.ids)
        self.items += 1

    def take(self, demand: tuple[int, int]) -> Item:
        item = self.classes[demand].pop()
        self.tokens -= len(item.ids)
        self.items -= 1
        return item

    def fill(self, enough: int) -> Iterator[list[Item]]:
        """Sequences, as long as more than ``enough`` tokens are left."""
        limits = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        while self.tokens > enough:
            self.classes = defaultdict(list, {k: held for k, held in self.classes.items() if held})
            keys = sorted(self.classes)
            demand = np.array([(n, 1, loss) for n, loss in keys])
            left = np.array([len(self.classes[k]) for k in keys])
            share = demand / limits
            scarce = (share * left[:, None]).sum(axis=0) / left.sum()
            weighted = share * scarce / limits
            # what is cut or given back meanwhile is seen when the classes are listed again
            for _ in range(LISTED):
                if self.tokens > enough and (sequence := self._sequence(keys, demand, left, weighted)):
                    yield sequence
                else:
                    break

    def _sequence(self, keys: list, demand: np.ndarray, left: np.ndarray, weighted: np.ndarray) -> list[Item]:
        """The next sequence; none if the items that are listed don't suffice, but there are others."""
        room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        out: list[Item] = []
        while (fits := (left > 0) & (demand <= room).all(axis=1)).any():
            best = int(np.where(fits, weighted @ room, -1.0).argmax())
            left[best] -= 1
            room = room - demand[best]
            out.append(self.take(keys[best]))
        longest = int(np.flatnonzero(left)[-1]) if left.any() else -1
        if longest < 0 and room.all() and self.items:
            for item in out:
                self.add(item)
            return []
        if longest >= 0 and room.all():
            at = self.classes[keys[longest]][-1].within(int(room[0]), int(room[2]))
            if at:
                left[longest] -= 1
                piece, rest = self.take(keys[longest]).split(at)
                out.append(piece)
                self.add(rest)
                room = room - [at, 1, piece.loss]
        held = self.limits.tokens - int(room[0])
        surplus = held - (1 << (held.bit_length() - 1)) if room[0] else 0
        while surplus:
            last = out.pop()
            if len(last.ids) > surplus:
                piece, last = last.split(len(last.ids) - surplus)
                out.append(piece)
            self.add(last)
            surplus -= len(last.ids)
        return out


def _pieces(item: Item, limits: Limits) -> Iterator[Item]:
    """What of an example fits into a sequence of its own, and the rest."""
    while len(item.ids) > limits.tokens or item.loss > limits.loss:
        piece, item = item.split(item.within(limits.tokens, limits.loss))
        yield piece
    yield item


def _packed(items: Iterator[Item], limits: Limits, first: int, last: bool) -> Iterator[tuple[int | None, int, Item]]:
    """(sequence, offset, piece) of all items; without ``last``, less than a sequence is left over and has no sequence."""
    pool, number = Pool(limits), itertools.count(first)

    def numbered(sequences: Iterator[list[Item]]) -> Iterator[tuple[int, int, Item]]:
        for sequence in sequences:
            at, k = 0, next(number)
            for piece in sequence:
                yield k, at, piece
                at += len(piece.ids)

    for item in items:
        for piece in _pieces(item, limits):
            if len(piece.ids) == limits.tokens:
                yield from numbered(iter([[piece]]))
            elif len(piece.ids):
                pool.add(piece)
        if pool.tokens >= WINDOW_TOKENS or pool.items >= WINDOW_ITEMS:
            yield from numbered(pool.fill(max(KEPT_TOKENS, limits.tokens)))
            if pool.items >= WINDOW_ITEMS:  # tiny ones alone
                yield from numbered(pool.fill(limits.tokens - 1))
    yield from numbered(pool.fill(0 if last else limits.tokens - 1))
    for held in list(pool.classes.values()):
        yield from ((None, 0, item) for item in held)


def _placed(batches: Iterator[pa.RecordBatch], items_of: Callable[[pa.RecordBatch], Iterator[Item]], limits: Limits, second: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of pieces; those without a sequence are for the second round."""
    first = (TaskContext.get().partitionId() << 32) + (SECOND if second else 0)
    items = (item for batch in batches for item in items_of(batch))
    if second:  # rows come in any order
        items = iter(sorted(items, key=lambda x: (len(x.ids), x.start, x.total, x.ids.tobytes(), str(x.example))))
    placed = _packed(items, limits, first, second)
    while rows := list(itertools.islice(placed, 1024)):
        number = lambda values: pa.array(values, pa.int64())
        each = [x for _, _, x in rows]
        columns = [
            pa.array([x.example for x in each], kind), number([x.start for x in each]), number([len(x.ids) for x in each]), number([x.total for x in each]), number([x.loss for x in each]),
            number([k for k, _, _ in rows]), number([at for _, at, _ in rows]), pa.array([x.ids.astype("<u4").tobytes() for x in each], pa.binary()),
            pa.array([None if x.mask is None else x.mask.tobytes() for x in each], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *(c.split()[0] for c in _COLUMNS.split(", "))])


def _again(batch: pa.RecordBatch) -> Iterator[Item]:
    """Items of the first round's rests: their own columns again."""
    for example, start, total, ids, mask in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 7, 8)), strict=True):
        yield Item(example, start, total, np.frombuffer(ids, "<u4"), None if mask is None else np.frombuffer(mask, np.uint8))


def _in_rounds(source: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[Item]], limits: Limits, id_col: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    of = source.schema["id"].dataType
    schema, kind = f"id {of.simpleString()}, {_COLUMNS}", to_arrow_type(of)
    first = materialize(source.mapInArrow(lambda b: released(_placed(b, items_of, limits, False, kind)), schema), "packed", "zstd")
    rest = first.filter("sequence_id is null")
    held = rest.agg(F.sum("length")).first()[0] or 0
    second = rest.repartition(held // WINDOW_TOKENS + 1).mapInArrow(lambda b: released(_placed(b, _again, limits, True, kind)), schema)
    return first.filter("sequence_id is not null").unionByName(second).withColumnRenamed("id", id_col)


def _byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies; the blank, which separates, stays."""
    spare = iter(range(256, 512))
    shown = lambda b: 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
    letters = [chr(b) if shown(b) else chr(next(spare)) for b in range(256)]
    letters[32] = " "
    return "".join(letters)


class Memo:
    """Ids of strings: a number for each string, and the ids of all in one array."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, strings: list[str], found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """``found``: ids and how many each of the strings has of them, in parts."""
        self.known.update(zip(strings, range(len(self.known), len(self.known) + len(strings))))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])))

    def of(self, coded: pa.DictionaryArray, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, and where those of each begin and end."""
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        said = pa.LargeListArray.from_arrays(pa.array(self.starts), pa.array(self.ids)).take(pa.array(at))
        return said.flatten().to_numpy(zero_copy_only=False), said.offsets.to_numpy(zero_copy_only=False)


class Words:
    """Encodes texts word by word, for a tokenizer that drops white space: then a text's ids are those of its words in turn.

    The words of many texts are told apart in Arrow, and a new one is encoded once, many in a call. MARK between them, which has an id
    of its own, tells where each ends. Where the tokenizer does no more than to lower, split by a pattern and merge bytes with word ends, words of
    Latin letters, on which all Unicode versions agree, are split here, and new pieces are merged by its model alone, which takes less than half the time.
    """

    MARK = "\x01"
    #: Letters below U+0180 but for the dotted capital I: composed already, and lowered one by one.
    PLAIN = re.compile("[\x00\x02-\u012f\u0131-\u017f]*")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id = self._ids(self.MARK).tolist()
        said = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = said["model"].get("end_of_word_suffix")
        self.bare = None
        if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and suffix:
            split = said["pre_tokenizer"]["pretokenizers"][0]
            if split["invert"] and split["behavior"] == "Removed" and all(t["content"].startswith("<|") for t in said["added_tokens"]):
                self.split = regex.compile(split["pattern"]["Regex"]).findall
                self.letters = _byte_letters()
                self.bare = Tokenizer(self.tokenizer.model)
                self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
                vocabulary = self.tokenizer.get_vocab()
                self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
                self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.pieces = Memo(), Memo()
        self.pieces.add([self.MARK], [(np.zeros(0, np.uint32), np.zeros(1, np.int64))])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: pieces by the pattern, new ones merged by the model, each of which ends in a token with the suffix."""
        coded = pa.array(self.split(f" {self.MARK} ".join(words).lower()), pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.pieces.known]
        found = []
        for k in range(0, len(new), 4096):
            text = " ".join(new[k : k + 4096]).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            found.append((ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)))
        self.pieces.add(new, found)
        ids, upto = self.pieces.of(coded, distinct)
        mark = distinct.index(self.MARK) if self.MARK in distinct else -1
        return ids, np.diff(np.append(upto[:-1][coded.indices.to_numpy(zero_copy_only=False) == mark], len(ids)), prepend=0)

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(f" {self.MARK} ".join(words))
        at = np.flatnonzero(ids == self.mark_id[0])
        return np.delete(ids, at), np.diff(at, prepend=-1, append=len(ids)) - 1

    def _learn(self, words: list[str]) -> None:
        plain, other, alone = [], [], []
        for w in words:
            if self.MARK in w or len(self.mark_id) != 1:
                alone.append(w)
            else:
                (plain if self.bare and self.PLAIN.fullmatch(w) and "<|" not in w else other).append(w)
        found = [self._merged(plain)] if plain else []
        found += [self._marked(other[k : k + 1024]) for k in range(0, len(other), 1024)]
        found += [(ids, np.array([len(ids)])) for ids in map(self._ids, alone)]
        self.words.add(plain + other + alone, found)

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[np.ndarray]:
        """The ids of each text; null texts aren't taken."""
        words = pc.ascii_split_whitespace(texts)
        n = words.value_lengths().to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.words.known) > MEMO_WORDS:
            self._forget()
        self._learn([w for w in distinct if w not in self.words.known])
        ids, upto = self.words.of(coded, distinct)
        last = np.array([] if end is None else [end], np.uint32)
        ends = upto[np.cumsum(n)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            yield np.append(ids[a:b], last)


@functools.lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """For all tasks of a worker, one after the other: what it remembers is bounded by MEMO_WORDS."""
    return Words(path)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), id_col: str = "id", ids_col: str = "ids", mask_col: str | None = None) -> DataFrame:
    """Pieces of examples in sequences: (``id_col``, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids, mask).

    ``ids_col`` is an array of token ids, ``mask_col`` one of as many booleans or 0s and 1s, true at loss-bearing tokens; without it, or where it is
    null, all are. ids are little-endian numbers of 32 bits, mask a byte for each, or null. Every id lies in one piece. A null or empty example has no piece;
    null and repeated ids are examples of their own. A sequence keeps to all ``limits`` and has as many tokens as they
    allow, or a power of two. Masks of another length than their ids raise ValueError. Other columns are not read.
    """
    mask = F.col(mask_col).cast("array<tinyint>") if mask_col else F.lit(None).cast("array<tinyint>")
    source = examples.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<long>").alias("ids"), mask.alias("mask"))

    def items(batch: pa.RecordBatch) -> Iterator[Item]:
        for example, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if mask is not None and len(mask) != len(ids or []):
                raise ValueError(f"{len(mask)} marks for {len(ids or [])} ids")
            yield Item(example, 0, len(ids or []), np.array(ids or [], np.uint32), None if mask is None else np.array([bool(m) for m in mask], np.uint8))

    return _in_rounds(source, items, limits, id_col)


def pack_texts(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of texts in sequences: columns and rules as for ``pack_examples``; every token bears loss.

    A text's ids are those that the library gives for the whole of it, without added special tokens, and then ``end`` unless that is None. The
    tokenizer has to drop white space: each distinct word is encoded by the library, and remembered by the worker. A null text counts as empty.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def items(batch: pa.RecordBatch) -> Iterator[Item]:
        words = _words(tokenizer_path)
        sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(sizes):
            upto = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + GROUP_BYTES, "right")))
            part = batch.slice(begin, upto - begin)
            for example, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1), end), strict=True):
                yield Item(example, 0, len(ids), ids, None)
            begin = upto

    return _in_rounds(source, items, limits, id_col)
