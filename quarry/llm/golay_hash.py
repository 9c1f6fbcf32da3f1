"""Near duplicates by SimHash fingerprints, joined through a perfect Golay code.

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 values of a text's word shingles, repeats
included. Two fingerprints link when at most two bits differ; every document gets the smallest doc_id that links lead to.

The code of length 23 has 4096 codewords, and every word of 23 bits lies within 3 bits of exactly one. Words within one
bit of each other decode to the same codeword, unless both lie 3 bits from theirs; then each one's codeword is one of
the five at 4 bits from the other. So the nearest codeword's index of one word is always among the one or six nearby
indices of the other. (Words two bits apart share one of their nearby indices too; one bit is all that is needed here.)

The plan:

1. One pass over the texts gives fingerprints; equal ones collapse into one node, so copies never meet each other.
2. A fingerprint is cut into three segments of 22, 21 and 21 bits. Two errors leave, for one of the three
   pairs (i, next i), segment i without an error and the next one with at most one. So a node is stored under three keys
   (segment i, nearest index of the next segment) and looks under (segment i, each nearby index).
3. Keys that hold no two fingerprints go. Those with at most ``bucket_rows`` rows are put together and verified.
4. Nodes that meet a larger key (a cluster of close fingerprints) go the exact way of that size: two fingerprints within
   two bits have a common neighbour within one bit, so each is put under its 65 neighbours. All that meet there link with
   each other, at most 65 of them, and a star of links keeps them connected.

No step lists the pairs of a group whose size grows with the data, and no key is met by more rows of a task than that.

Defined cases: a null or blank text has the fingerprint zero, which links like any other; a text of one or two words is
one shingle; texts are hashed whole, a few megabytes at a time; equal texts, repeated rows and ties go to the smallest
doc_id; a row without a doc_id takes the component of its fingerprint, which is null if none of its members has a doc_id;
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import label_components
from quarry.llm.text import slices, utf8
from quarry.runtime import Workspace

#: Segments of a fingerprint: (lowest bit, bits). Each is followed by the next one, the last by the first.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101


@dataclass(frozen=True)
class HashSpec:
    words: int = 3
    seed: int = 42
    bucket_rows: int = 64
    salts: int = 64


def fingerprint(text: bytes | None, spec: HashSpec) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    width = min(spec.words, len(parts))
    runs = map(b" ".join, zip(*(parts[k : len(parts) - width + 1 + k] for k in range(width)), strict=True))
    count, ones = len(parts) - width + 1, np.zeros(64, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(spec.seed)), np.uint64, count)
    for at in range(0, count, 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: HashSpec | None = None) -> DataFrame:
    """id and print (the fingerprint as a signed long) of each row; one pass, no shuffle."""
    spec = spec or HashSpec()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            found = np.fromiter((fingerprint(t.as_py(), spec) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "print"])

    return docs.select(F.col(key).alias("id"), utf8(F.col(text))).mapInArrow(run, f"id {kind}, print long")


@cache
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by the generator of words of the lower 12 and of the upper 11 bits."""

    def rest(w: int) -> int:
        while w.bit_length() > 11:
            w ^= GENERATOR << (w.bit_length() - 12)
        return w

    # The remainder is linear, so a table doubles with each bit.
    def table(bits: range) -> np.ndarray:
        found = np.zeros(1, np.int64)
        for b in bits:
            found = np.concatenate([found, found ^ rest(1 << b)])
        return found

    return table(range(12)), table(range(12, 23))


def syndromes(words: np.ndarray) -> np.ndarray:
    low, high = _remainders()
    return low[words & 0xFFF] ^ high[words >> 12]


@cache
def _errors() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the errors to the nearest codeword and to those at 4 bits of a word at 3 bits; and their number (1 or 6)."""
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for e, s in zip(patterns.tolist(), syndromes(patterns).tolist(), strict=True):
            if weight < 4 or found[s][0].bit_count() == 3:
                found[s].append(e)
    return np.array([(x * 6)[:6] for x in found], np.int64), np.array(list(map(len, found)), np.int64)


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6) codeword indices, the nearest first, and how many of each row count."""
    errors, sizes = _errors()
    s = syndromes(words)
    return (words[:, None] ^ errors[s]) >> 11, sizes[s]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, whether it is stored there) for all keys of unsigned fingerprints."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    rows, keys, stored = [], [], []
    for i in range(3):
        index, n = nearby(parts[(i + 1) % 3])
        count = np.arange(6)[None, :] < n[:, None]
        r, k = np.nonzero(count)
        rows.append(r)
        keys.append((np.int64(i) << 34) | (parts[i][r] << 12) | index[r, k])
        stored.append(k == 0)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(stored)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                prints = batch.column(0).slice(at, 8192).to_numpy()
                r, k, s = keys_of(prints.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(prints[r]), pa.array(k), pa.array(s)], names=["print", "key", "stored"])

    return nodes.select("print").mapInArrow(run, "print long, key long, stored boolean")


def _neighbours(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under itself and all fingerprints at one bit."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                prints = batch.column(0).slice(at, 2048).to_numpy()
                near = (prints.view(np.uint64)[:, None] ^ flips).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(prints, 65)), pa.array(near.ravel())], names=["print", "key"])

    return nodes.select("print").mapInArrow(run, "print long, key long")


def _differ(x, y):
    return F.bit_count(x.bitwiseXOR(y))


def links(ws: Workspace, nodes: DataFrame, spec: HashSpec, stars: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (``print``) within two bits; with ``stars`` only as many as connect them."""
    keyed = ws.save(_keyed(nodes), "keys")
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("print").alias("lo"), F.max("print").alias("hi"), F.max("stored").alias("any"))
    met = ws.save(met.where("lo != hi and any").select("key", "n"), "met")
    salt = F.pmod(F.xxhash64("print", F.lit(7)), F.lit(spec.salts)).cast("int").alias("salt")
    hot = met.where(F.col("n") > spec.bucket_rows).select("key", F.explode(F.sequence(F.lit(0), F.lit(spec.salts - 1))).alias("salt"), F.lit(True).alias("hot"))
    tagged = ws.save(keyed.select("*", salt).join(hot, ["key", "salt"], "left").select("print", "key", "stored", F.col("hot").isNotNull().alias("hot")), "tagged")
    cold = tagged.where("not hot").join(met.where(F.col("n") <= spec.bucket_rows).select("key"), "key", "left_semi")
    groups = cold.groupBy("key").agg(F.collect_list(F.when(F.col("stored"), F.col("print"))).alias("kept"), F.collect_list("print").alias("seek"))
    pairs = groups.select("kept", F.explode("seek").alias("s")).select("s", F.explode("kept").alias("k")).where((F.col("s") != F.col("k")) & (_differ(F.col("s"), F.col("k")) <= 2))
    pairs = pairs.select(F.least("s", "k").alias("a"), F.greatest("s", "k").alias("b"))
    crowd = _neighbours(tagged.where("hot").select("print").distinct()).groupBy("key").agg(F.array_sort(F.collect_list("print")).alias("all")).where(F.size("all") > 1)
    if stars:
        joined = crowd.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    else:
        joined = crowd.select("all", F.posexplode("all").alias("at", "a")).select("a", F.explode(F.slice("all", F.col("at") + 2, F.lit(65))).alias("b"))
    return ws.save(pairs.union(joined).distinct(), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: HashSpec | None = None) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hexadecimal digits), component_id."""
    spec = spec or HashSpec()
    ws = Workspace(docs.sparkSession, "golay-hash")
    prints = ws.save(fingerprints(docs, key, text, spec), "prints")
    # Rows of a fingerprint that a large share of all rows has are dealt over salts.
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1024)).cast("int"))
    part = ws.save(salted.groupBy("print", "salt").agg(F.min("id").alias("least")), "part")
    nodes = ws.save(part.groupBy("print").agg(F.min("least").alias("least")), "nodes")
    found = links(ws, nodes, spec, stars=True)
    ws.drop("keys", "tagged")
    ws.release()
    labels = label_components(ws, nodes.select(F.col("print").alias("node")), found, "labels").withColumnRenamed("node", "print")
    tops = nodes.join(labels, "print").withColumn("salt", F.pmod(F.xxhash64("print", F.lit(3)), F.lit(1024)).cast("int"))
    least = tops.groupBy("component", "salt").agg(F.min("least").alias("least"))
    least = least.select("component", "salt").join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    known = ws.save(tops.drop("least").join(least, ["component", "salt"]).select("print", "component_id"), "known")
    out = salted.join(part.select("print", "salt").join(known, "print"), ["print", "salt"])
    return out.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def linked_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: HashSpec | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between distinct fingerprints (a, b, bits) and the membership of rows (key, print)."""
    spec = spec or HashSpec()
    ws = Workspace(docs.sparkSession, "golay-hash")
    prints = ws.save(fingerprints(docs, key, text, spec), "prints")
    found = links(ws, prints.select("print").distinct(), spec)
    return found.select("a", "b", _differ(F.col("a"), F.col("b")).alias("bits")), prints.withColumnRenamed("id", key)
