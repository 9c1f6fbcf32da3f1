"""Best-fit packing of token sequences with vector capacities.

Documents become token ids plus an end mark, cut into pieces of at most ``capacity`` tokens. A piece of full length
is a sequence of its own; the others are packed best-fit decreasing. A bin is a vector of what is left: tokens,
documents and attention cost (the sum of squared piece lengths). Among the bins in which a piece stays under every
capacity, the best has the smallest weighted norm of what would be left (``rule='norm'``), or the largest weighted dot
product of what is left with what the piece takes (``rule='dot'``); capacities scale the dimensions to 1.

Pieces are numbered and dealt evenly over tasks of about ``task_pieces`` pieces, each packed alone: a task has at most one
bin that more pieces would have helped, so the loss is about one sequence per task.

Defined cases: null text is empty and becomes one piece, the end mark alone; special tokens' strings in a text are
ordinary text; repeated rows are pieces of their own, and so are rows that share a doc_id or have none; pieces of one length may lie in any order; texts
of any length are encoded whole; a document of exact multiples of the capacity has no empty last
piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import list_array
from quarry.runtime import Workspace


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class PackSpec:
    tokenizer: str = "word_bpe_49k.json"
    end_id: int = 0
    capacity: int = 2048
    max_documents: int = 2048
    max_attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"
    task_pieces: int = 16_384


_CLOSING = ".,;:!?*#$%&|"
# One lower-case form each, and no marks that combine.
_LETTERS = string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_TOKENIZERS: dict[str, object] = {}


class TokenCache:
    """Token ids of blocks of texts, by way of their distinct words.

    The tokenizer works on letter runs, digits and other runs between white space, so a text's ids are those of its words
    in order. Arrow splits a block and numbers its distinct words. A word of letters and closing punctuation is put together
    from its lower-case letters and its punctuation; any other word is encoded as it is. All three are kept from block to block of a
    task, in Arrow arrays, and found there by Arrow; the table starts anew at ``limit`` texts or ``size`` bytes. New letter runs are encoded many at a
    time with a digit behind each, by the tokenizer's model without its normalizer and patterns, which leave them as they are; where a
    probe shows that a tokenizer's don't, by the tokenizer itself.
    """

    def __init__(self, tokenizer, limit: int = 300_000, size: int = 32_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.size = tokenizer, limit, size
        self._forget()
        mark = tokenizer.encode("1", add_special_tokens=False).ids
        if len(mark) != 1:
            raise ValueError("a digit is no token of its own in this tokenizer")
        self.mark = mark[0]
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        lower = _LETTERS.lower()
        probe = " 1 ".join([*lower, lower, lower[::-1]])
        if self.plain.encode(probe).ids != tokenizer.encode(probe, add_special_tokens=False).ids:
            self.plain = tokenizer

    def _forget(self) -> None:
        self.texts, self.ids = pa.array([""]), pa.array([[]], pa.list_(pa.uint32()))

    def _encode_runs(self, runs: pa.Array) -> pa.Array:
        """Ids of runs of lower-case letters."""
        starts = np.append(np.arange(0, len(runs), 64), len(runs)).astype(np.int32)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), runs), " 1 ").to_pylist()
        parts = [np.empty(0, np.uint32)]
        for i in range(0, len(groups), 128):  # an encoding takes far more memory than its ids
            found = self.plain.encode_batch_fast([g + " 1" for g in groups[i : i + 128]], add_special_tokens=False)
            parts += [np.array(e.ids, np.uint32) for e in found]
        ids = np.concatenate(parts)
        ends = np.flatnonzero(ids == self.mark)
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends - np.arange(len(ends))).astype(np.int32)), pa.array(ids[ids != self.mark]))

    def _encode_each(self, texts: pa.Array) -> pa.Array:
        found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
        return list_array([np.array(e.ids, np.uint32) for e in found], pa.uint32())

    def _places(self, texts: pa.Array) -> np.ndarray:
        """Where in the table each text's ids are; new texts are added."""
        at = pc.index_in(texts, value_set=self.texts)
        new = pc.unique(texts.filter(at.is_null()))
        if len(new) and (len(self.texts) + len(new) > self.limit or self.texts.nbytes + self.ids.nbytes > self.size):
            self._forget()
            new = pc.unique(texts.filter(pc.not_equal(texts, "")))
        if len(new):
            letters = pc.equal(pc.binary_length(pc.utf8_ltrim(new, _LETTERS)), 0)
            runs, others = new.filter(letters), new.filter(pc.invert(letters))
            self.texts = pa.concat_arrays([self.texts, runs, others])
            self.ids = pa.concat_arrays([self.ids, self._encode_runs(runs), self._encode_each(others)])
            at = pc.index_in(texts, value_set=self.texts)
        return at.to_numpy()

    def _ids_of_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        stems, closings = pc.utf8_rtrim(words, _CLOSING), pc.utf8_ltrim(words, _LETTERS)
        simple = pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(closings)), pc.binary_length(words))
        parts = pa.concat_arrays([pc.if_else(simple, pc.utf8_lower(stems), words), pc.if_else(simple, closings, "")])
        in_turn = self._places(parts).reshape(2, -1).T.ravel()  # each word's letters, then its punctuation
        ids = self.ids.take(pa.array(in_turn))
        return pa.ListArray.from_arrays(ids.offsets.take(pa.array(np.arange(0, len(ids) + 1, 2))), ids.values)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a block, as bytes of unsigned 32-bit numbers."""
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        ids = self._ids_of_words(coded.dictionary.cast(pa.string())).take(coded.indices)
        bounds = 4 * ids.offsets.to_numpy().astype(np.int64)[ends]
        raw = ids.values.to_numpy().astype("<u4", copy=False).tobytes()
        return [raw[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def cached(path: str) -> TokenCache:
    """A cache for one task over this worker's tokenizer, so that workers don't hold words while they do other things."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = load_tokenizer(path)
    return TokenCache(_TOKENIZERS[path])


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def blocks(texts: pa.Array, size: int = 4_000_000) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes, one text at least; null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


def pieces(docs: DataFrame, spec: PackSpec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece; one pass, no shuffle."""
    path = _public(spec.tokenizer) if "/" not in spec.tokenizer else spec.tokenizer
    kind = docs.schema[key].dataType.simpleString()
    step = 4 * spec.capacity
    end = np.array([spec.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached(path)
        for b in batches:
            rows, nth, start, length, crc = [], [], [], [], []
            encoded = (ids + end for part in blocks(b.column(1)) for ids in cache.encode(part))
            for i, ids in enumerate(encoded):
                for n, o in enumerate(range(0, len(ids), step)):
                    part = ids[o : o + step]
                    rows.append(i)
                    nth.append(n)
                    start.append(o // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(nth, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, spec: PackSpec) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; vector best-fit in order of decreasing length.

    Bins with equal residual vectors are alike, so the search runs over distinct residuals, each with a stack of bins.
    """
    caps = np.array([spec.capacity, spec.max_documents, spec.max_attention], float)
    weights = np.array(spec.weights)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    slot: dict[tuple[int, int, int], int] = {}
    left = np.empty((64, 3))
    stacks: list[list[int]] = []
    used, opened = 0, 0
    for i in order:
        n = int(lengths[i])
        take = np.array([n, 1, n * n], float)
        after = left[:used] - take
        fits = (after >= 0).all(1)
        if fits.any():
            if spec.rule == "norm":
                cost = ((after / caps) ** 2 @ weights)
            else:
                cost = -((left[:used] / caps) @ (weights * take / caps))
            s = int(np.where(fits, cost, np.inf).argmin())
            b = stacks[s].pop()
            room = tuple(int(x) for x in left[s])
            if not stacks[s]:  # the last slot moves into the gap
                del slot[room]
                used -= 1
                if s != used:
                    left[s] = left[used]
                    stacks[s] = stacks[used]
                    slot[tuple(int(x) for x in left[s])] = s
                stacks.pop()
        else:
            b, room = opened, (spec.capacity, spec.max_documents, spec.max_attention)
            opened += 1
        bins[i], offsets[i] = b, spec.capacity - room[0]
        rest = (room[0] - n, room[1] - 1, room[2] - n * n)
        if rest[0] < smallest or rest[1] < 1 or rest[2] < smallest * smallest:
            continue
        at = slot.get(rest)
        if at is None:
            if used == len(left):
                left = np.concatenate([left, np.empty_like(left)])
            at = slot[rest] = used
            left[used] = rest
            stacks.append([])
            used += 1
        stacks[at].append(b)
    return bins, offsets


def pack_documents(docs: DataFrame, spec: PackSpec | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset for each piece of ``docs``."""
    spec = spec or PackSpec()
    if spec.rule not in ("norm", "dot"):
        raise ValueError(f"rule is 'norm' or 'dot', not {spec.rule!r}")
    ws = Workspace(docs.sparkSession, "packing")
    numbered = ws.save(pieces(docs, spec, key, text).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    cut = numbered.drop("_row")
    names = cut.columns
    short = F.col("length") < spec.capacity
    tasks = max(1, -(-cut.where(short).count() // spec.task_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if not found:
            return
        t = pa.Table.from_batches(found).sort_by([(key, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        b, o = pack(t["length"].to_numpy(), spec)
        t = t.append_column("sequence_id", pa.array(b + (np.int64(TaskContext.get().partitionId() + 1) << 32), pa.int64())).append_column("offset", pa.array(o, pa.int64()))
        yield from t.to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    # Rows go by their numbers, so equal documents, however many, are dealt like any others and no task gets more than its share.
    dealt = numbered.where(short).repartition(tasks, F.xxhash64("_row")).drop("_row")
    packed = dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    alone = cut.where(~short).select(*names, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
