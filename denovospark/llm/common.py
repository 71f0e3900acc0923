"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, materialize

__all__ = ["WORD", "Memo", "discard", "id_fold", "lower_words", "materialize", "mix", "pack", "released", "table", "unpack"]

T = TypeVar("T")

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(WORD.encode())
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z in lower case."""
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, xor, multiply), so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Memo(dict):
    """Values of ``function`` by argument, ``most`` of them at a time. For one task: it ends with the generator that holds it."""

    def __init__(self, function: Callable, most: int) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key: Hashable) -> object:
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.function(key)
        return value


def released(batches: Iterator[T]) -> Iterator[T]:
    """The batches of a task; at its end the memory that it used goes back to the machine, as workers are used again."""
    yield from batches
    del batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pack(x: np.ndarray) -> bytes:
    """An array's bytes, compressed: what is shuffled and written is then small whatever codec the cluster uses."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
