"""Operator 4: byte-level BPE encoding and decoding by a monoid tree reduction.

A text is halved until a part is short, the parts are encoded, and two neighbours are joined by encoding again only a
window around the cut. A window grows until it begins and ends at a position that is stable: between an ASCII space or
line feed and a character before it that isn't white space. No match of the pattern contains such a pair, wherever it
begins, so the position splits the matches of every text that contains it, and the ids outside the window are those of
the whole text. Joined ids of (a, m) and (m, b) are therefore the ids of (a, b) encoded alone: the operation is
associative, and the empty text is its unit. Decoding concatenates the bytes of the two halves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released


def _codec(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return encoding.encode_ordinary, pieces, [str(i) for i in range(len(pieces))]


def stable(text: str, at: int) -> bool:
    return text[at] in " \n" and not text[at - 1].isspace()


def _last_stable(text: str, a: int, m: int) -> int:
    """The last stable position in (a, m], or a; the window grows to twice its length at each try."""
    width, high = 16, m
    while high > a:
        low = max(a, m - width)
        for at in range(high, low, -1):
            if stable(text, at):
                return at
        high, width = low, 2 * width
    return a


def _first_stable(text: str, m: int, b: int) -> int:
    """The first stable position in [m, b), or b."""
    width, low = 16, m
    while low < b:
        high = min(b, m + width)
        for at in range(low, high):
            if stable(text, at):
                return at
        low, width = high, 2 * width
    return b


def _without(ids: list[int], n_bytes: int, pieces: list[bytes], back: bool) -> int:
    """How many ids at the end (``back``) or the start make up ``n_bytes``."""
    n, order = 0, reversed(ids) if back else iter(ids)
    while n_bytes > 0:
        n_bytes -= len(pieces[next(order)])
        n += 1
    if n_bytes:
        raise AssertionError("a stable position splits a token")
    return n


def encode_tree(text: str, encode, pieces: list[bytes], leaf: int = 4096, a: int = 0, b: int | None = None) -> list[int]:
    """The ids of text[a:b], encoded alone."""
    b = len(text) if b is None else b
    if b - a <= leaf:
        return encode(text[a:b])
    m = (a + b) // 2
    left, right = encode_tree(text, encode, pieces, leaf, a, m), encode_tree(text, encode, pieces, leaf, m, b)
    u, v = _last_stable(text, a, m), _first_stable(text, m, b)
    if u == m or v == m:  # the cut itself is stable
        return left + right
    keep = len(left) - _without(left, len(text[u:m].encode()), pieces, True)
    skip = _without(right, len(text[m:v].encode()), pieces, False)
    return left[:keep] + encode(text[u:v]) + right[skip:]


def decode_tree(ids: list[int], pieces: list[bytes], leaf: int = 4096, a: int = 0, b: int | None = None) -> bytes:
    b = len(ids) if b is None else b
    if b - a <= leaf:
        return b"".join([pieces[i] for i in ids[a:b]])
    m = (a + b) // 2
    return decode_tree(ids, pieces, leaf, a, m) + decode_tree(ids, pieces, leaf, m, b)


def _digests(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    encode, pieces, names = _codec(path)
    for batch in batches:
        out: list[tuple] = []
        for value in batch.column(1):
            ids = encode_tree(value.as_py() or "", encode, pieces, leaf)
            said = ",".join([names[i] for i in ids])
            out.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decode_tree(ids, pieces, leaf)).hexdigest()))
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    encode, pieces, _ = _codec(path)
    for batch in batches:
        ids = [encode_tree(v.as_py() or "", encode, pieces, leaf) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    _, pieces, _ = _codec(path)
    for batch in batches:
        out = [decode_tree(v.as_py() or [], pieces, leaf) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])


def _mapped(df: DataFrame, id_col: str, value_col: str, function, path: str, leaf: int, columns: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    return source.mapInArrow(lambda batches: released(function(batches, path, leaf)), f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode_bpe(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096) -> DataFrame:
    """(``id_col``, ids array<int>): the ids of every whole text; null is as empty. One row for each input row, no shuffle."""
    return _mapped(df, id_col, text_col, _encode, ranks_path, leaf, "ids array<int>")


def decode_bpe(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids", leaf: int = 4096) -> DataFrame:
    """(``id_col``, bytes binary): what the ids stand for; null is as empty. An unknown id raises IndexError."""
    return _mapped(df, id_col, ids_col, _decode, ranks_path, leaf, "bytes binary")


def digest_bpe(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 4096) -> DataFrame:
    """Encode and decode every text, and return (``id_col``, n_tokens, ids_sha256, decoded_sha256) without moving the ids.

    A null text counts as empty; null and repeated ids are passed through; other columns are not read.
    """
    return _mapped(df, id_col, text_col, _digests, ranks_path, leaf, "n_tokens long, ids_sha256 string, decoded_sha256 string")
