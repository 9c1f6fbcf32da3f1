"""Near duplicates by a grouped prefix join on word shingles.

Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of distinct five-word shingles (ASCII
lower case). The result is exact: every document gets the smallest doc_id that links lead to.

The plan, none of whose steps lists all pairs of a group:

1. One pass over the texts turns each into its shingle hashes. Equal sets collapse into one node (the smallest id),
   told apart by their size and a 128-bit sum. Only the ``head`` of a set goes on: its smallest hashes, a little more
   than a prefix filter needs.
2. Two sets that link share at least ``need`` hashes of their heads. A node with fewer head hashes that occur in any
   other node is alone and leaves. The counts are aggregated before they are shuffled.
3. For the nodes that remain, whole sets are computed again and ordered by how many nodes hold each hash, rarest
   first. The prefix of that order is what must overlap.
4. Nodes with the same size and the same prefix form one group; postings hold groups. Group pairs pass the size
   filter, then members are verified on whole sets.
5. A posting list is first verified against one pivot (and each group against its first member), so that a large
   group of near copies becomes one component after as many checks as it has members. Later rounds look only at
   members outside the component of their list's pivot, against a growing, hashed choice of pivots that ends with
   all members: after the last round each pair of a list was verified, lies in one component, or can't link by a
   bound. There are two bounds on a pair besides the sizes: hashes that no other node holds can't be shared, and the
   number of bits in which the parity sketches of two sets differ is never more than the size of their symmetric
   difference. Only pairs within the bounds ship whole sets.

Hot keys are dealt over salts: a text that a third of all rows copy, empty texts (which join nothing), a prefix that
thousands of near copies share, and a pivot that meets all members of its group. Each salt of a hot key has a small
row of its own (the least id seen, or the pivot's set) that its rows meet. Links and labels are pairs of ids; where one
id is hot there, their joins are left to the splitting of skewed partitions at run time.

Defined cases: a null or blank text has an empty set and links with nothing; a text with one to four words is one
shingle; a text of any length is hashed whole, a few megabytes of texts at a time; equal rows collapse, and ties go to
the smallest doc_id; rows that share a doc_id count as one document; a row without a doc_id takes the component of
equal texts with one; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import label_components
from quarry.llm.text import WordHash, list_array, mix, slices, utf8
from quarry.runtime import Workspace


@dataclass(frozen=True)
class JoinSpec:
    words: int = 5
    percent: int = 80
    first_pivots: int = 8
    growth: int = 4
    sketch_longs: int = 16
    salts: int = 1024

    def alpha(self, n: int) -> int:
        """Least overlap with any set that a set of ``n`` shingles links with."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.alpha(n) + 1

    def need(self, n: int) -> int:
        return max(1, self.prefix(n) // 2)

    def head(self, n: int) -> int:
        return min(n, self.prefix(n) + self.need(n) - 1)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int, table: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    parts = (text or b"").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.int64)
    h = np.fromiter(map(table.__getitem__, parts), np.uint64, n)
    width = min(words, n)
    a = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        a = a * _MUL + h[k : n - width + 1 + k]
    return np.unique(mix(a).view(np.int64))


def sketch(tokens: np.ndarray, longs: int) -> np.ndarray:
    """Parity of the number of hashes that fall on each of 64 * ``longs`` bits."""
    bits = np.bincount(tokens & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _set_pass(docs: DataFrame, key: str, text: str, spec: JoinSpec, whole: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHash()
        for batch in slices(batches, 1):  # few sets at a time
            sets = [shingles(b.as_py(), spec.words, table) for b in batch.column(1)]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            if whole:
                sketches = list_array([sketch(s, spec.sketch_longs) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes, list_array(sets, pa.int64()), sketches], names=["id", "n", "tokens", "sketch"])
                continue
            one = [int(s.sum()) for s in sets]
            two = [int(mix(s.view(np.uint64) ^ _MUL).view(np.int64).sum()) for s in sets]
            heads = list_array([s[: spec.head(len(s))] for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(one, pa.int64()), pa.array(two, pa.int64()), heads], names=["id", "n", "s1", "s2", "head"])

    rest = "tokens array<long>, sketch array<long>" if whole else "s1 long, s2 long, head array<long>"
    return docs.select(F.col(key).alias("id"), utf8(F.col(text))).mapInArrow(run, f"id {kind}, n long, {rest}")


def _alpha(n, spec: JoinSpec):
    return F.floor((F.lit(spec.percent) * n + F.lit(99)) / F.lit(100)).cast("long")


def _salt(by: str, spec: JoinSpec):
    return F.pmod(F.xxhash64(by, F.lit(3)), F.lit(spec.salts)).cast("int")


def _with_least(rows: DataFrame, keys: list[str], name: str, spec: JoinSpec) -> DataFrame:
    """``rows`` (keys, id, ...) with the least id of their key; a key's rows are dealt over salts."""
    salted = rows.withColumn("salt", _salt("id", spec))
    part = salted.groupBy(*keys, "salt").agg(F.min("id").alias("least"))
    return salted.join(_spread(part, keys, name), [*keys, "salt"]).drop("salt")


def _spread(part: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, salt, ``name``: the least of the key) from the least of each salt."""
    return part.join(part.groupBy(*keys).agg(F.min("least").alias(name)), keys).drop("least")


def _beside(pairs: DataFrame, links: DataFrame, rows: DataFrame, side: str, other: str, spec: JoinSpec) -> DataFrame:
    """``pairs`` with the columns of ``rows`` for ``side``; each salt of an id in many pairs meets a copy of its row.

    ``links`` are the bare pairs that ``pairs`` derive from.
    """
    needed = links.select(side, _salt(other, spec).alias("salt")).distinct()
    copies = needed.join(rows.withColumnRenamed("id", side), side)
    return pairs.withColumn("salt", _salt(other, spec)).join(copies, [side, "salt"]).drop("salt")


def _verified(ws: Workspace, name: str, pairs: DataFrame, members: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """Pairs (a, b) whose whole sets are similar enough; sketches rule out most others before sets are shipped."""
    pairs = ws.save(pairs, f"{name}-pairs")
    ks = [f"k{i}" for i in range(spec.sketch_longs)]
    one = members.select("id", "n", "shared", *ks)
    two = members.select("id", *(F.col(c).alias(f"p{c}") for c in ("n", "shared", *ks)))
    near = _beside(_beside(pairs, pairs, one, "b", "a", spec), pairs, two, "a", "b", spec)
    near = ws.save(near.where(_may_link(spec)).select("a", "b"), f"{name}-near")
    left = sets.select("id", F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select("id", F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    met = _beside(_beside(near, near, right, "b", "a", spec), near, left, "a", "b", spec)
    return ws.save(met.where(100 * both >= spec.percent * (F.col("na") + F.col("nb") - both)).select("a", "b"), name)


def _fits(x: str, y: str, spec: JoinSpec):
    """The size filter: the smaller set is large enough to reach the similarity at all."""
    return 100 * F.least(x, y) >= spec.percent * F.greatest(x, y)


def _may_link(spec: JoinSpec):
    """Bounds for pairs of (n, shared, k0...) with (pn, pshared, pk0...); links are never excluded."""
    both = F.least("shared", "pshared")
    differ = F.bit_count(F.col("k0").bitwiseXOR(F.col("pk0")))
    for i in range(1, spec.sketch_longs):
        differ = differ + F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"pk{i}")))
    total = F.col("n") + F.col("pn")
    # |A & B| = (total - |A ^ B|) / 2 and |A | B| = (total + |A ^ B|) / 2
    return _fits("n", "pn", spec) & (100 * both >= spec.percent * (total - both)) & (100 * (total - differ) >= spec.percent * (total + differ))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: JoinSpec | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id."""
    spec = spec or JoinSpec()
    ws = Workspace(docs.sparkSession, "prefix-join")
    base = ws.save(_set_pass(docs, key, text, spec, whole=False), "base")
    ids = ws.save(base.select("id", "n", "s1", "s2"), "ids")
    salted = ids.where("n > 0").withColumn("salt", _salt("id", spec))
    part = ws.save(salted.groupBy("n", "s1", "s2", "salt").agg(F.min("id").alias("least")), "part")
    reps = part.groupBy("n", "s1", "s2").agg(F.min("least").alias("rep"))
    live = ws.save(_survivors(base, reps, spec), "live")
    ws.drop("base")
    ws.release()
    texts = docs.select(key, text).join(live.select(F.col("id").alias(key)), key, "left_semi").dropDuplicates([key, text])
    sets = ws.save(_set_pass(texts, key, text, spec, whole=True), "sets")
    ws.release()
    prefixes = ws.save(_prefixes(sets, spec), "prefixes")
    ws.release()
    labels = _components(ws, prefixes, sets, spec)
    known = reps.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    known = part.drop("least").join(known, ["n", "s1", "s2"])
    out = salted.join(known, ["n", "s1", "s2", "salt"]).select("id", "n", F.coalesce("component", "id").alias("component"))
    out = out.union(ids.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _survivors(base: DataFrame, reps: DataFrame, spec: JoinSpec) -> DataFrame:
    nodes = base.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").where("n > 0")
    post = nodes.select("id", "n", F.explode("head").alias("token"))
    shared = post.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2").select("token")
    prefix = F.col("n") - _alpha(F.col("n"), spec) + 1
    need = F.greatest(F.lit(1), F.floor(prefix / 2) - 1)
    hits = post.join(shared, "token", "left_semi").groupBy("id", "n").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= need).select("id").distinct()


def _prefixes(sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """id, n and the shared hashes inside the rarest-first prefix; nodes whose prefix nobody shares leave."""
    post = sets.select("id", "n", F.explode("tokens").alias("token"))
    counts = post.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2")
    per = post.join(counts, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    prefix = F.col("n") - _alpha(F.col("n"), spec) + 1
    take = (prefix - (F.col("n") - F.size("ranked"))).cast("int")
    return per.withColumn("take", take).where("take > 0").select("id", "n", F.size("ranked").cast("long").alias("shared"), F.transform(F.slice("ranked", F.lit(1), F.col("take")), lambda x: x["token"]).alias("prefix"))


def _components(ws: Workspace, prefixes: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    marks = prefixes.select("id", "n", "shared", F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(5), "prefix").alias("p2"))
    members = _with_least(marks, ["n", "p1", "p2"], "gid", spec).select("id", "n", "shared", "gid")
    members = ws.save(members.join(sets.select("id", *(F.col("sketch")[i].alias(f"k{i}") for i in range(spec.sketch_longs))), "id"), "members")
    ks = [f"k{i}" for i in range(spec.sketch_longs)]
    firsts = members.where("id = gid").select("id")
    lists = ws.save(prefixes.join(firsts, "id", "left_semi").select(F.col("id").alias("gid"), "n", F.explode("prefix").alias("token")), "lists")
    inside = members.where("id != gid").select(F.col("gid").alias("a"), F.col("id").alias("b"))
    pivots = lists.groupBy("token").agg(F.min_by("n", "gid").alias("pn"), F.min("gid").alias("pivot"))
    across = lists.join(pivots, "token").where(F.col("gid") != F.col("pivot")).where(_fits("n", "pn", spec))
    pairs = inside.union(across.select(F.col("pivot").alias("a"), F.col("gid").alias("b"))).distinct()
    links = _verified(ws, "links0", pairs, members, sets, spec)
    labels = label_components(ws, members.select(F.col("id").alias("node")), links, "labels0")
    ws.release()
    largest = lists.join(members.groupBy("gid").count(), "gid").groupBy("token").agg(F.sum("count").alias("m")).agg(F.max("m")).first()[0] or 0
    low, high, step = 0, spec.first_pivots, 1
    while low < largest:
        posts = lists.select("gid", "token").join(members.select("gid", "id"), "gid").join(labels.withColumnRenamed("node", "id"), "id")
        open_ = posts.groupBy("token").agg(F.count("*").alias("m"), F.min_by("component", "id").alias("main"), F.max("component").alias("hi"), F.min("component").alias("lo"))
        posts = posts.join(open_.where("hi != lo").where(F.col("m") > low).select("token", "m", "main"), "token")
        posts = ws.save(posts.join(members.drop("gid"), "id"), f"posts{step}")
        if posts.isEmpty():
            break
        spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("m")
        chosen = posts.where((spot >= low) & (spot < high))
        p = chosen.select("token", F.col("id").alias("p"), F.col("component").alias("pc"), *(F.col(c).alias(f"p{c}") for c in ("n", "shared", *ks)))
        q = posts.where("component != main")
        near = q.join(p, "token").where((F.col("pc") != F.col("component")) & _may_link(spec))
        pairs = near.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        links = _verified(ws, f"links{step}", pairs, members, sets, spec)
        labels = label_components(ws, labels, links, f"labels{step}")
        ws.release()
        low, high, step = high, high * spec.growth, step + 1
    return labels
