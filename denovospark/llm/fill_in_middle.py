"""Operator 12: fill-in-middle transformation by succinct rank and select.

The texts of an Arrow batch are one run of bytes. A packed bit vector marks the bytes that end a unit (a line feed, or the last byte of
a text), another one those that begin a character; a directory holds the ones before each block of 512 bits. A text's units are
a difference of two ranks, a cut behind unit k is one select, and characters before a cut are a rank again; all texts of a batch
are answered at once. Line feeds are single bytes of UTF-8, so a cut never splits a character.

What is random comes from a hash of the document's id: the same document is always cut alike, however the table is split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_WORDS = 8  # of 64 bits, in a block
_BITS = 64 * _WORDS
#: Bytes of texts that are cut at once, unless one text has more.
GROUP_BYTES = 4 << 20


class BitVector:
    """Packed bits with the number of ones before each block: rank and select of arrays of places."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(bits) // _BITS + 1) * _WORDS, np.uint64)  # one spare place, so that rank(len) needs no case
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words.reshape(-1, _WORDS)
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))])

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block, word, bit = at // _BITS, at // 64 % _WORDS, (at % 64).astype(np.uint64)
        counts = np.bitwise_count(self.words[block]).astype(np.int64)
        before = np.where(np.arange(_WORDS) < word[:, None], counts, 0).sum(axis=1)
        rest = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.directory[block] + before + np.bitwise_count(rest)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The place of each n-th one, from 0; n has to be under ``total``."""
        block = np.searchsorted(self.directory, nth, "right") - 1
        left = nth - self.directory[block]
        counts = np.cumsum(np.bitwise_count(self.words[block]).astype(np.int64), axis=1)
        word = (counts <= left[:, None]).sum(axis=1)
        each = np.arange(len(nth))
        left = left - np.where(word > 0, counts[each, word - 1], 0)
        bits = np.unpackbits(self.words[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * _BITS + word * 64 + (np.cumsum(bits, axis=1) > left[:, None]).argmax(axis=1)


def draws(doc_id: str, seed: int) -> tuple[int, int, int, int]:
    """Four whole numbers of 32 bits from the hash of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode("utf-8", "surrogatepass")).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4]) for k in range(4))


def cuts(texts: list[bytes], drawn: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """For each text: its units, the bytes before either cut, and the characters before either cut."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - [len(t) for t in texts]
    boundary = data == 10
    boundary[ends[ends > starts] - 1] = True
    units, characters = BitVector(boundary), BitVector((data & 0xC0) != 0x80)
    first = units.rank(starts)
    n = units.rank(ends) - first
    h = np.array(drawn, np.int64)
    behind = np.sort(np.stack([h[:, 0] % (n + 1), h[:, 1] % (n + 1)]), axis=0)
    places = []
    for k in behind:
        at = starts.copy()
        at[k > 0] = units.select((first + k - 1)[k > 0]) + 1
        places.append(at)
    before = characters.rank(starts)
    return n, places[0] - starts, places[1] - starts, characters.rank(places[0]) - before, characters.rank(places[1]) - before


def _formed(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    def group(ids: list, keys: list[str], texts: list[bytes]) -> pa.RecordBatch:
        drawn = [draws(k, seed) for k in keys]
        n, low, high, prefix, upto = cuts(texts, drawn)
        forms, outputs = [], []
        for text, a, b, h in zip(texts, low.tolist(), high.tolist(), drawn, strict=True):
            if not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
                forms.append("plain")
                outputs.append(text)
            elif h[3] % 100 < spm:
                forms.append("spm")
                outputs.append(b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])))
            else:
                forms.append("psm")
                outputs.append(b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])))
        plain = np.array([f == "plain" for f in forms])
        columns = [ids, pa.array(n), pa.array(forms), pa.array(prefix, mask=plain), pa.array(upto - prefix, mask=plain), pa.array(outputs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    for batch in batches:
        ids, keys, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(ids):
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + GROUP_BYTES, "right")))
            yield group(ids.slice(begin, end - begin), keys[begin:end], texts.slice(begin, end - begin).to_pylist())
            begin = end


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Texts cut into prefix, middle and suffix at whole lines, and put in another order.

    Returns (``id_col``, n, form, prefix_chars, middle_chars, output), a row for each input row. ``rate`` of a hundred documents are
    transformed, ``spm`` of a hundred of these begin with their suffix. Form is plain, and the output the text, for the others, for empty and
    null texts, and for texts that hold a mark. A null id draws like an empty one; repeated ids draw alike. Other columns are not read.
    There is no shuffle: a row is cut where it is read. Texts are whole, whatever their length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    key, text = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), key.alias("key"), text.cast("binary").alias("text"))
    cut = source.mapInArrow(lambda b: released(_formed(b, seed, rate, spm)), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks occur in it once each, as texts that hold one are left plain."""
    p, s, m = PREFIX.decode(), SUFFIX.decode(), MIDDLE.decode()
    behind = lambda x, mark: F.substring_index(x, mark, -1)
    until = lambda x, mark: F.substring_index(x, mark, 1)
    prefix = F.when(form == "psm", until(behind(output, p), s)).otherwise(until(behind(output, p), m))
    suffix = F.when(form == "psm", until(behind(output, s), m)).otherwise(until(behind(output, s), p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, behind(output, m), suffix))
