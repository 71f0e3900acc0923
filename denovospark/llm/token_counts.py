"""Operator 1: token counts by overlap resynchronisation.

A text is cut into chunks that overlap, each chunk is encoded with offsets, and neighbouring chunks are spliced at a
position that starts a pre-token in both. Why that is exact: pre-tokens are matched from left to right without looking
back, and the merges of one pre-token don't depend on the others, so the encoding from such a position on depends on the
text from there on alone. The left chunk's own boundary counts only if everything that its matcher may have looked at
lies within the chunk: a special string that begins before the boundary, a contraction, and the white space that runs
up to it. Where the overlap holds no such position, the left chunk is encoded again with an overlap twice as long, and keeps it
for the chunks that follow until a position is found: text without any is encoded a bounded number of times over, however long.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Characters that a match before a boundary may look at beyond it: the longest special string and a contraction.
MARGIN = 16
#: Chunks that are encoded at once.
GROUP = 512


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _starts_pretoken(encoding, i: int) -> bool:
    return i == 0 or encoding.token_to_word(i) != encoding.token_to_word(i - 1)


def common_boundary(text: str, left, left_at: int, left_end: int, right, right_at: int) -> tuple[int, int, int] | None:
    """The first stable boundary of both encodings: its place in the text and the token that starts there in each."""
    for j in range(len(right)):
        at = right_at + right.token_to_chars(j)[0]
        if at + MARGIN > left_end:
            return None
        if not _starts_pretoken(right, j) or text[at].isspace() and text[at + 1].isspace():
            continue
        i = left.char_to_token(at - left_at)
        if i is not None and left.token_to_chars(i)[0] == at - left_at and _starts_pretoken(left, i):
            return at, i, j
    return None


def splice(text: str, encode, first: list, step: int, overlap: int) -> tuple[int, int]:
    """Tokens of ``text``, and how often an overlap had to be widened. ``first``: the encodings of its chunks."""
    n, total, widened, wide = len(text), 0, 0, overlap
    left, left_at, left_end, begin = first[0], 0, min(n, step + overlap), 0
    for k in range(1, len(first)):
        right_at = k * step
        right_end = min(n, right_at + step + overlap)
        while left_end < n and (found := common_boundary(text, left, left_at, left_end, first[k], right_at)) is None:
            if left_end >= right_end:  # the left chunk covers the right one
                break
            wide, widened = 2 * wide, widened + 1
            left_end = min(n, left_end + wide)
            left = encode(text[left_at:left_end])
        if left_end >= n:
            break
        if found is None:
            continue
        total += found[1] - begin
        left, left_at, left_end, begin, wide = first[k], right_at, right_end, found[2], overlap
    return total + len(left) - begin, widened


def _chunks(text: str, step: int, overlap: int) -> list[str]:
    return [text[a : a + step + overlap] for a in range(0, max(1, len(text) - overlap), step)]


def _count(batches: Iterator[pa.RecordBatch], path: str, step: int, overlap: int, limit: int) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False)
    for batch in batches:
        tokens, parts, wider = [], [], []
        todo: list[tuple[str, int]] = []
        queue: list[str] = []

        def flush() -> None:
            done, at = tokenizer.encode_batch(queue, add_special_tokens=False), 0
            for text, n in todo:
                count, widened = splice(text, encode, done[at : at + n], step, overlap)
                tokens.append(count)
                parts.append(n)
                wider.append(widened)
                at += n
            todo.clear()
            queue.clear()

        for value in batch.column(2):
            text = value.as_py() or ""
            chunks = _chunks(text, step, overlap)
            todo.append((text, len(chunks)))
            queue += chunks
            if len(queue) >= GROUP:
                flush()
        flush()
        counts = pa.array(tokens, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), counts, pa.array([t > limit for t in tokens], pa.bool_()), pa.array(parts, pa.int32()), pa.array(wider, pa.int32())],
            names=["id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
        )


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, step: int = 2048, overlap: int = 64) -> DataFrame:
    """Tokens of every text, as the library counts them on the whole text without added special tokens.

    Returns (``id_col``, n_bytes, n_tokens, over_limit, n_chunks, n_widened), a row for each input row. A null text counts
    as empty; null and repeated ids are passed through; other columns are not read. ``step`` and ``overlap`` are in
    characters and don't change any count. There is no shuffle: a row is encoded where it is read.
    """
    if overlap <= MARGIN or step <= 0:
        raise ValueError(f"overlap has to be over {MARGIN} characters and step positive")
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = source.mapInArrow(
        lambda batches: released(_count(batches, tokenizer_path, step, overlap, limit)),
        f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int",
    )
    return counted.withColumnRenamed("id", id_col)
