"""Word handling that several operators share. Words are maximal runs of bytes outside 0x20 and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\r\x0b\x0c"


class WordHash(dict):
    """word (bytes) -> 64-bit hash; forgets everything beyond ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words with good avalanche (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(b: bytes) -> int:
    return len(b.translate(None, _CONTINUATION))


def word_code_points(b: bytes) -> int:
    return len(b.translate(None, _CONTINUATION + _SPACE))


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text; null stays null."""
    return text.cast("binary")


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow list column from numpy rows, without Python objects per value."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def word_count(text: Column) -> Column:
    """Number of words of a text on the JVM; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds about ``size`` bytes, one row at least, so that memory follows no row count."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, side="right"))))
            yield batch.slice(at, stop - at)
            at = stop
