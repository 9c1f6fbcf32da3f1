"""Alignment of two tokenizers over the same texts.

Tokenizer A (byte-level BPE) encodes space + text, tokenizer B (BPE pieces with byte fallback, which adds the space itself)
encodes the text. Where the bytes of both give space + text back, the ends of all tokens cut it into elementary intervals:
the union of both end arrays. A binary search gives each interval's owner in A and in B, so an interval is one overlap of two
tokens. An end that both have closes a group; within a group every A token links with every B token, a product that is expanded
from the groups' sizes.

What a link is worth is known only over all documents: how many of them hold its id pair. The plan:

1. One pass over the texts aligns them, in blocks of some megabytes. A block lists its distinct pairs, with the number of its documents
   that hold each, in rows of some ten thousand; a document is a row with its figures and its pairs as places in that list.
2. The blocks' pairs are added up by pair, and each pair is compared with the highest count of its A id. A pair is at most one
   row a block, however many documents hold it, so frequent pairs (a comma with a comma) are small before they are shuffled.
3. Each block's pairs meet their counts, which go back to the block's documents.

So what a task holds is bounded by a block (or one text, if longer), and no list of tokens or links is shuffled by document
or by pair.

Defined cases: null and empty texts, and texts whose bytes one tokenizer doesn't give back (U+2581, which stands for a space in B;
invalid UTF-8) have no tokens: zeros and an empty text for the hash; strings of special tokens inside a text are ordinary text; texts
of any length are aligned whole; repeated rows, and rows that share a doc_id, or have none, are documents of their own; ties for
an A id's highest count all count as best; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.text import list_array, slices, utf8
from quarry.runtime import Workspace


@dataclass(frozen=True)
class AlignSpec:
    a: str = "byte_bpe_50k.json"
    b: str = "piece_bpe_32k.model"
    ranks: str | None = "byte_bpe_50k.tiktoken"  # the vocabulary of ``a`` as ranks, or None
    part_bytes: int = 2_000_000
    block_bytes: int = 16_000_000
    products: int = 4_000_000  # links expanded at once
    run: int = 65_536  # pairs in a row or batch


def _public(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class Vocabulary:
    """Bytes of each id of a tokenizer, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array(list(map(len, tokens)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class ByteTokenizer:
    """Byte-level BPE. The same vocabulary as ranks is several times faster; it serves texts in which both split words alike:
    letters below U+0250, whose classes no version of Unicode has changed, and no run without a change of white space beyond 2000 bytes.
    """

    _LATIN = re.compile("[ɐ-\U0010ffff]")
    _LONG = 2000

    def __init__(self, path: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        printed = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD) and not 0x7F <= b <= 0xA0]
        letter = {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printed)}
        tokens = [b""] * self.slow.get_vocab_size()
        for t, i in self.slow.get_vocab().items():
            tokens[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        self.vocabulary = Vocabulary(tokens)
        self.fast = self._by_ranks(ranks) if ranks else None

    @staticmethod
    def _by_ranks(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, raw: bytes) -> np.ndarray:
        if self.fast and not self._LATIN.search(text):
            blank = np.frombuffer(raw, np.uint8) <= 0x20
            turns = np.flatnonzero(blank[1:] != blank[:-1])
            if np.diff(turns, prepend=-1, append=len(raw)).max() <= self._LONG:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int64)
        return np.array(self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class PieceTokenizer:
    """BPE pieces with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        piece = lambda i: self.model.id_to_piece(i)
        self.vocabulary = Vocabulary([bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


_LOADED: dict[tuple, Aligner] = {}


@dataclass
class Aligned:
    """Groups of a part's texts; positions run over all texts that kept their bytes, one after the other."""

    whole: np.ndarray  # which texts have tokens
    a: np.ndarray  # ids
    b: np.ndarray
    a_ends: np.ndarray  # byte offsets
    b_ends: np.ndarray
    cuts: np.ndarray  # ends of elementary intervals
    a_owner: np.ndarray  # token of each interval
    b_owner: np.ndarray
    shared: np.ndarray  # ends of groups
    a_group: np.ndarray  # group of each token
    b_group: np.ndarray
    doc_ends: np.ndarray  # byte offsets of the whole texts' ends


class Aligner:
    def __init__(self, a: str, b: str, ranks: str | None):
        self.a, self.b = ByteTokenizer(a, ranks), PieceTokenizer(b)
        na, nb = len(self.a.vocabulary.tokens), len(self.b.vocabulary.tokens)
        self.base = nb
        # What stands in the listing of groups for each id, inside and at the end of its side of a group.
        self.names = [x for i in range(na) for x in (b"%d," % i, b"%d|" % i)] + [x for i in range(nb) for x in (b"%d," % i, b"%d;" % i)]
        self.offset = 2 * na

    @classmethod
    def of(cls, a: str, b: str, ranks: str | None) -> Aligner:
        """One of a worker."""
        if (a, b, ranks) not in _LOADED:
            _LOADED[a, b, ranks] = cls(a, b, ranks)
        return _LOADED[a, b, ranks]

    def align(self, texts: list[bytes | None]) -> Aligned:
        whole = np.array([bool(t) for t in texts], bool)
        raw = [b" " + texts[i] for i in np.flatnonzero(whole)]
        plain = [t.decode("utf-8", "replace") for t in raw]
        a = [self.a.encode(t, r) for t, r in zip(plain, raw, strict=True)]
        b = self.b.encode_all([t[1:] for t in plain])
        good = self._intact(a, raw, self.a.vocabulary) & self._intact(b, raw, self.b.vocabulary)
        whole[whole] = good
        keep = np.flatnonzero(good).tolist()
        none = np.empty(0, np.int64)
        ids_a, ids_b = (np.concatenate([x[i] for i in keep]) if keep else none for x in (a, b))
        ends_a, ends_b = np.cumsum(self.a.vocabulary.sizes[ids_a]), np.cumsum(self.b.vocabulary.sizes[ids_b])
        cuts = np.union1d(ends_a, ends_b)
        own_a, own_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        shared = cuts[(ends_a[own_a] == cuts) & (ends_b[own_b] == cuts)]
        doc_ends = np.cumsum([len(raw[i]) for i in keep], dtype=np.int64)
        return Aligned(whole, ids_a, ids_b, ends_a, ends_b, cuts, own_a, own_b, shared, np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b), doc_ends)

    @staticmethod
    def _intact(ids: list[np.ndarray], raw: list[bytes], words: Vocabulary) -> np.ndarray:
        good = np.array([int(words.sizes[x].sum()) == len(r) for x, r in zip(ids, raw, strict=True)], bool)
        keep = np.flatnonzero(good)
        if len(keep):
            same = words.spell(np.concatenate([ids[i] for i in keep])) == np.frombuffer(b"".join([raw[i] for i in keep]), np.uint8)
            ends = np.cumsum([len(raw[i]) for i in keep])
            good[keep] = np.add.reduceat(~same, ends - [len(raw[i]) for i in keep], dtype=np.int64) == 0
        return good

    def hashes(self, g: Aligned) -> list[str]:
        """SHA-256 of each whole text's listing of groups."""
        n = len(g.shared)
        na, nb = np.bincount(g.a_group, minlength=n), np.bincount(g.b_group, minlength=n)
        upto_a, upto_b = np.cumsum(na), np.cumsum(nb)
        codes = np.empty(len(g.a) + len(g.b), np.int64)
        last_a, last_b = np.zeros(len(g.a), np.int64), np.zeros(len(g.b), np.int64)
        last_a[upto_a - 1] = last_b[upto_b - 1] = 1
        codes[np.arange(len(g.a)) + (upto_b - nb)[g.a_group]] = 2 * g.a + last_a
        codes[np.arange(len(g.b)) + upto_a[g.b_group]] = self.offset + 2 * g.b + last_b
        names = list(map(self.names.__getitem__, codes.tolist()))
        ends = (np.searchsorted(g.a_ends, g.doc_ends) + np.searchsorted(g.b_ends, g.doc_ends) + 2).tolist()
        return [hashlib.sha256(b"".join(names[i:j])[:-1]).hexdigest() for i, j in zip([0, *ends], ends, strict=False)]

    def links(self, g: Aligned, products: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whole text, pair, times) of all links, in order of text and pair; a pair is a * (ids of B) + b."""
        n = len(g.shared)
        nb = np.bincount(g.b_group, minlength=n)
        first_b = (np.cumsum(nb) - nb)[g.a_group]
        each = nb[g.a_group]
        upto = np.cumsum(each)
        doc = np.searchsorted(g.doc_ends, g.a_ends)
        span = (len(self.a.vocabulary.tokens) + 1) * self.base
        keys, times = [], []
        at = 0
        while at < len(g.a):
            done = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, done + products, side="right")))
            e = each[at:stop]
            k = np.repeat(doc[at:stop] * span + g.a[at:stop] * self.base, e)
            k += g.b[np.repeat(first_b[at:stop] - (np.cumsum(e) - e), e) + np.arange(len(k))]
            k, t = np.unique(k, return_counts=True)
            keys.append(k)
            times.append(t)
            at = stop
        if not keys:
            return (np.empty(0, np.int64),) * 3
        key, count = keys[0], times[0]
        if len(keys) > 1:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.zeros(len(key), np.int64)
            np.add.at(count, place, np.concatenate(times))
        return key // span, key % span, count


def _aligner(spec: AlignSpec) -> tuple[str, str, str | None]:
    return _public(spec.a), _public(spec.b), _public(spec.ranks) if spec.ranks else None


def _blocks(docs: DataFrame, key: str, text: str, spec: AlignSpec) -> DataFrame:
    """Rows of documents and, with a null hash, of runs of a block's pairs; both name their block.

    A row is one document or one run, never a block, so that no writer, reader or sort holds more of a block than some rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    paths = _aligner(spec)
    figures = ("n_a", "n_b", "n_groups", "n_links")
    names = ["block", "id", *figures, "hash", "places", "times", "at", "pairs", "holding"]
    types = [pa.int64(), None, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def rows(id_type: pa.DataType, n: int, **some: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([some[c] if c in some else pa.nulls(n, t or id_type) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*paths)
        block = np.int64(TaskContext.get().partitionId()) << 32
        kept, held = [], 0

        def block_rows() -> Iterator[pa.RecordBatch]:
            coded = pa.array(np.concatenate([part[4] for part in kept])).dictionary_encode()
            place, pairs = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            holding = np.bincount(place, minlength=len(pairs)).astype(np.int32)
            id_type, done = kept[0][0].type, 0
            for ids, numbers, hashes, sizes, pair, times in kept:
                ends = np.cumsum(sizes)
                at = 0
                while at < len(ids):  # no more pairs in a batch than in a run, other than those of one document
                    before = int(ends[at - 1]) if at else 0
                    stop = max(at + 1, int(np.searchsorted(ends, before + spec.run, side="right")))
                    some = slice(before, int(ends[stop - 1]))
                    offsets = pa.array(np.concatenate(([0], ends[at:stop] - before)), pa.int32())
                    lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for c, x in (("places", place[done + some.start : done + some.stop]), ("times", times[some]))}
                    columns = {c: pa.array(numbers[at:stop, i]) for i, c in enumerate(figures)}
                    yield rows(id_type, stop - at, block=pa.array(np.full(stop - at, block)), id=ids.slice(at, stop - at), hash=pa.array(hashes[at:stop], pa.string()), **columns, **lists)
                    at = stop
                done += len(pair)
            for at in range(0, len(pairs), spec.run):
                one = {"pairs": list_array([pairs[at : at + spec.run]], pa.int64()), "holding": list_array([holding[at : at + spec.run]], pa.int32())}
                yield rows(id_type, 1, block=pa.array([block]), at=pa.array([at], pa.int32()), **one)

        for part in slices(batches, 1, rows=4096, size=spec.part_bytes):
            texts = part.column(1).to_pylist()
            g = aligner.align(texts)
            n, at = len(texts), np.flatnonzero(g.whole)
            number = np.zeros((n, 4), np.int64)
            docs_of = [np.searchsorted(g.doc_ends, x) for x in (g.a_ends, g.b_ends, g.shared)]
            products = np.bincount(g.a_group, minlength=len(g.shared)) * np.bincount(g.b_group, minlength=len(g.shared))
            for i, d in enumerate(docs_of):
                number[at, i] = np.bincount(d, minlength=len(at))
            whole_links = np.zeros(len(at), np.int64)
            np.add.at(whole_links, docs_of[2], products)
            number[at, 3] = whole_links
            doc, pair, count = aligner.links(g, spec.products)
            size = np.zeros(n, np.int64)
            size[at] = np.bincount(doc, minlength=len(at))
            named = np.full(n, "", object)
            named[at] = aligner.hashes(g)
            ids = part.column(0)
            # a copy of the ids, since a slice keeps the whole batch with its texts
            kept.append((ids.take(pa.array(np.arange(n))), number, named, size, pair, count.astype(np.int32)))
            held += sum(map(len, filter(None, texts)))
            if held >= spec.block_bytes:
                yield from block_rows()
                block += 1
                kept, held = [], 0
        if kept:
            yield from block_rows()

    schema = f"block long, id {kind}, " + ", ".join(f"{c} long" for c in figures) + ", hash string, places array<int>, times array<int>, at int, pairs array<long>, holding array<int>"
    return docs.select(F.col(key), utf8(F.col(text))).mapInArrow(run, schema)


def pair_counts(runs: DataFrame, base: int) -> DataFrame:
    """pair, n (documents that hold it) and best (whether no other B id has more with its A id)."""
    rows = runs.select(F.explode(F.arrays_zip("pairs", "holding")).alias("p")).select("p.pairs", "p.holding")
    total = rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holding").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / base))  # at most as many rows as B has ids
    return total.withColumn("best", F.col("n") == F.max("n").over(of_a))


def alignment_figures(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: AlignSpec | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spec = spec or AlignSpec()
    kind = docs.schema[key].dataType.simpleString()
    ws = Workspace(docs.sparkSession, "token-alignment")
    blocks = ws.save(_blocks(docs, key, text, spec), "blocks")
    runs = blocks.where("hash is null").select("block", "at", "pairs", "holding")
    counts = ws.save(pair_counts(runs, _b_size(spec)), "counts")
    wanted = runs.select("block", "at", F.posexplode("pairs").alias("nth", "pair")).select("block", (F.col("at") + F.col("nth")).alias("at"), "pair")
    met = wanted.join(counts, "pair").select(F.col("block").alias("of"), "at", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        at = right["at"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        for whole in left.to_batches():
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                place, times = b["places"].flatten().to_numpy(), b["times"].flatten().to_numpy().astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(pc.list_value_length(b["places"]).to_numpy())))
                sums = [np.concatenate(([0], np.cumsum(times * v[place])))[ends] for v in (best, n)]
                out.append(pa.Table.from_arrays([b["id"], b["n_a"], b["n_b"], b["n_groups"], b["n_links"], *(pa.array(np.diff(s)) for s in sums), b["hash"]], names=names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], f.type) for f in empty], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    empty = [pa.field(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in names]
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in names[1:-1]) + ", groups_sha256 string"
    # A block without pairs has no counts, but its documents stay.
    out = blocks.where("hash is not null").drop("at", "pairs", "holding").groupBy("block").cogroup(met.groupBy("of")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", key)


def _b_size(spec: AlignSpec) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_public(spec.b)).get_piece_size()


def aligned_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: AlignSpec | None = None) -> DataFrame:
    """Every group of every text: key, nth, start, end (bytes of space + text), a_ids, b_ids and overlaps.

    ``overlaps`` are the group's elementary intervals: the places of their owners among the text's tokens of A and of B, and their end.
    """
    spec = spec or AlignSpec()
    paths = _aligner(spec)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*paths)
        for part in slices(batches, 1, rows=512, size=spec.part_bytes // 8):
            g = aligner.align(part.column(1).to_pylist())
            n = len(g.shared)
            doc = np.searchsorted(g.doc_ends, g.shared)
            begins = np.concatenate(([0], g.doc_ends[:-1]))[doc] if n else g.shared
            count = lambda x: np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n)))).astype(np.int32)
            owner = lambda own, ends: own - np.searchsorted(ends, begins[in_group], side="right")
            in_group = np.searchsorted(g.shared, g.cuts)
            first = np.searchsorted(doc, doc)
            starts = np.where(np.arange(n) == first, 0, np.concatenate(([0], g.shared[:-1])) - begins) if n else g.shared
            interval = pa.StructArray.from_arrays(
                [pa.array(owner(g.a_owner, g.a_ends), pa.int32()), pa.array(owner(g.b_owner, g.b_ends), pa.int32()), pa.array(g.cuts - begins[in_group], pa.int64())], names=["a", "b", "end"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.flatnonzero(g.whole)[doc])),
                    pa.array(np.arange(n) - first, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(g.shared - begins, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(count(g.a_group)), pa.array(g.a, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(count(g.b_group)), pa.array(g.b, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(count(in_group)), interval),
                ],
                names=["id", "nth", "start", "end", "a_ids", "b_ids", "overlaps"],
            )

    schema = f"id {kind}, nth int, start long, end long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a: int, b: int, end: long>>"
    return docs.select(F.col(key), utf8(F.col(text))).mapInArrow(run, schema).withColumnRenamed("id", key)
