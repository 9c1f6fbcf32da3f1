"""Quality rules by compressibility.

A text is compressed whole and in fixed chunks with zstandard. Compressed size over plain size is low for repetitive
text (templates, symbol decoration, copied lists) and high for text without structure (keys, encoded data, noise).
What is normal depends on the length, because a short text gives the compressor little to refer back to, so each
band of lengths has its own lower and upper limit. Chunks have limits of their own: a long text can hide a repeated
or an incompressible part inside a normal average.

The default limits were set on labelled prose in four languages, with a margin below and above the extremes of texts of
good quality.

Base rules come first: too few words, or too many words inside repeated five-word windows.

Defined cases: null text is an empty text; a text with fewer than ``min_words`` words fails the base rules; the
tail of a text belongs to a chunk only if it has half a chunk at least; a text of any length is measured whole, a few
megabytes of texts at a time; nothing depends on other rows, so copies and ties get equal verdicts; an empty table gives
an empty result; other columns, whatever their names, are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import code_points, slices, utf8, word_code_points
from quarry.runtime import ship

_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class BandLimits:
    """Limits of compressed/plain size. Bands: (bytes from this length on, lowest ratio kept, highest ratio kept)."""

    level: int = 3
    chunk_bytes: int = 4096
    chunk_low: float = 0.425
    chunk_high: float = 0.60
    bands: tuple[tuple[int, float, float], ...] = field(
        default=(
            (0, 0.90, 1.40),
            (64, 0.70, 1.30),
            (128, 0.59, 1.10),
            (256, 0.55, 0.90),
            (512, 0.48, 0.82),
            (1024, 0.45, 0.72),
            (2048, 0.437, 0.65),
            (4096, 0.415, 0.60),
            (8192, 0.400, 0.58),
            (16384, 0.380, 0.56),
            (65536, 0.330, 0.56),
        )
    )
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20

    def of(self, n_bytes: int) -> tuple[float, float]:
        low, high = self.bands[0][1:]
        for start, a, b in self.bands:
            if n_bytes >= start:
                low, high = a, b
        return low, high


def repeat_words(words: list[bytes], window: int) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    starts = np.fromiter((i for i, g in enumerate(grams) if counts[g] > 1), np.int64)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(text: bytes, limits: BandLimits, squeeze: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    n = len(words)
    repeated = repeat_words(words, limits.window)
    ratio = len(squeeze.compress(text)) / max(1, len(text))
    size = limits.chunk_bytes
    chunks = [text[o : o + size] for o in range(0, len(text), size)]
    parts = [len(squeeze.compress(c)) / len(c) for c in chunks if 2 * len(c) >= size] if len(text) >= size else []
    low, high = limits.of(len(text))
    base_failed = n < limits.min_words or 100 * repeated > limits.max_repeat_percent * n
    in_band = low <= ratio <= high and all(limits.chunk_low <= p <= limits.chunk_high for p in parts)
    return (
        n,
        word_code_points(text),
        len(text) - len(text.translate(None, _SYMBOLS)),
        dup_lines(text),
        repeated,
        code_points(text),
        ratio,
        min(parts, default=None),
        max(parts, default=None),
        base_failed,
        not base_failed and in_band,
    )


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars_text long, ratio double, chunk_min double, chunk_max double, base_failed boolean, kept boolean"


def judge(docs: DataFrame, limits: BandLimits | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and the verdict ``kept`` for each row of ``docs``; one pass, no shuffle."""
    ship(docs.sparkSession)
    limits = limits or BandLimits()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=limits.level)
        for batch in slices(batches, 1):
            rows = [measure(b.as_py() or b"", limits, squeeze) for b in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _TYPES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True))], names=[key, *_NAMES])

    return docs.select(F.col(key), utf8(F.col(text)).alias("_utf8")).mapInArrow(run, f"{key} {kind}, {_SCHEMA}")


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def keep_good(docs: DataFrame, limits: BandLimits | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is kept, with all their columns; the text travels through the same single pass."""
    ship(docs.sparkSession)
    limits = limits or BandLimits()
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=limits.level)
        for batch in slices(batches, at):
            mask = [measure(b.as_py() or b"", limits, squeeze)[-1] for b in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
