"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample (the vectors with the smallest hashes of vec_id: 32 for each partition, 8000 at least and
32,768 at most): a neighbour graph of the sample is cut into balanced partitions (median splits along principal
directions, then moves that gain neighbours within a size limit), and a small network learns which partitions hold a
vector's neighbours. There are about as many partitions as the square root of the table's rows, within bounds. How many
of them a query visits is measured on sample queries: the fewest that reach ``target`` recall, and as many as hold ``k``
rows. Vectors with neighbourhoods need few; where all directions are alike, most partitions must be visited.

Searching: every row of the table goes to its most probable partition; a query goes to its most probable few, and all
their rows are reranked by exact distance. A partition is dealt out over as many chunks as its rows ask for, so a
vector that a third of all rows share is no hot task; a chunk keeps its ten best for each query, and these meet once.
Rows are copied only where more than ``query_block`` queries visit their partition, once for each such block.

Defined cases: vectors that are null, zero, or with null or non-finite components take no part; vectors are compared
with those of their own length only, and lengths other than the commonest of the sample have one partition each; ties go
to the smaller vec_id; rows that share a query's vec_id aren't its candidates, and of several such queries the smallest
vector asks; a query with fewer candidates than ``k`` in the whole table gets all of them; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.runtime import Workspace


@dataclass(frozen=True)
class PartitionSpec:
    k: int = 10
    every: int = 100
    sample: int = 8000
    most_sample: int = 32_768
    parts: int | None = None
    least_parts: int = 32
    most_parts: int = 1024
    graph: int = 24
    hidden: int = 256
    epochs: int = 30
    target: float = 0.97
    slack: float = 1.08
    least_chunk: int = 256
    most_chunk: int = 65_536
    query_block: int = 65_536
    seed: int = 11

    def parts_of(self, rows: int) -> int:
        """About the square root of the rows, as a power of two."""
        return self.parts or min(self.most_parts, max(self.least_parts, 1 << (max(1, rows).bit_length() - 1) // 2))

    def sample_of(self, parts: int) -> int:
        return min(self.most_sample, max(self.sample, 32 * parts))


def _nearest(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Row numbers of the k nearest rows of x, in blocks."""
    found = []
    norms = (x * x).sum(1)
    for at in range(0, len(q), 512):
        d = norms - 2 * q[at : at + 512] @ x.T
        if skip is not None:
            d[np.arange(len(d)), skip[at : at + 512]] = np.inf
        found.append(np.argpartition(d, min(k, d.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(found)


def _median_splits(x: np.ndarray, parts: int) -> np.ndarray:
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        split = []
        for rows in groups:
            c = x[rows] - x[rows].mean(0)
            axis = np.linalg.eigh(c.T @ c)[1][:, -1]
            order = rows[np.argsort(c @ axis, kind="stable")]
            split += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = split
    for i, rows in enumerate(groups):
        label[rows] = i
    return label


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, slack: float, rounds: int = 12) -> np.ndarray:
    """Partition of the neighbour graph whose parts hold at most ``slack`` times their equal share."""
    label = _median_splits(x, parts)
    limit = int(np.ceil(slack * len(x) / parts))
    src = np.repeat(np.arange(len(x)), graph.shape[1])
    dst = graph.ravel()
    for _ in range(rounds):
        links = np.zeros((len(x), parts), np.int32)
        np.add.at(links, (src, label[dst]), 1)
        np.add.at(links, (dst, label[src]), 1)
        best = links.argmax(1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), label]
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < limit:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def _learn(x: np.ndarray, soft: np.ndarray, spec: PartitionSpec) -> Router:
    """Two-layer network on the share of each partition among a vector's neighbours, by Adam."""
    rng = np.random.default_rng(spec.seed)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], spec.hidden)), np.zeros(spec.hidden), rng.normal(0, np.sqrt(2 / spec.hidden), (spec.hidden, soft.shape[1])), np.zeros(soft.shape[1])]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(spec.epochs):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            e = np.exp(o - o.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - soft[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for i, d in enumerate((z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p)


def fit_router(x: np.ndarray, spec: PartitionSpec, parts: int) -> Router:
    """Graph, balanced partitions, network and the number of partitions to visit, all from the sample ``x``."""
    x = np.unique(x, axis=0)
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    if parts == 1:
        d = x.shape[1] if x.size else 1
        return Router(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = _nearest(x, x, spec.graph, np.arange(len(x)))
    label = balanced_partition(x, graph, parts, spec.slack)
    soft = np.full((len(x), parts), 1e-3)
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
    soft[np.arange(len(x)), label] += 2
    router = _learn(x, soft / soft.sum(1, keepdims=True), spec)
    home = router.ranked(x, 1)[:, 0]
    probe = np.random.default_rng(spec.seed).choice(len(x), min(len(x), 1000), replace=False)
    near = _nearest(x[probe], x, min(spec.k, len(x) - 1), probe)
    place = np.empty((len(probe), parts), np.int64)
    np.put_along_axis(place, router.ranked(x[probe], parts), np.arange(parts)[None], 1)
    rank = np.take_along_axis(place, home[near], 1)
    router.visits = next(v for v in range(1, parts + 1) if (rank < v).mean() >= spec.target)
    return router


def nearest_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, distance) of each query's k nearest rows by (exact distance, id)."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    group = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    once = np.sort(np.unique(np.stack([group, row_ids], 1), axis=0, return_index=True)[1])  # repeated rows count once
    rows, row_ids, order, group = rows[once], row_ids[once], order[once], group[once]
    seen = np.bincount(group)
    if (seen > k + 1).any():  # of equal vectors only the k + 1 smallest ids can be among the nearest
        by = np.argsort(group, kind="stable")
        nth = np.empty(len(rows), np.int64)
        nth[by] = np.arange(len(rows)) - np.concatenate(([0], np.cumsum(seen)[:-1]))[group[by]]
        keep = nth <= k
        rows, row_ids, order = rows[keep], row_ids[keep], order[keep]
    norms = (rows * rows).sum(1)
    n = min(k, len(rows))
    out = []
    for start in range(0, len(queries), 64):  # few at a time, so that the distances of a block stay small
        asked = queries[start : start + 64]
        block = norms - 2 * asked @ rows.T
        for i, (q, rough) in enumerate(zip(asked, block, strict=True), start):
            rough[row_ids == query_ids[i]] = np.inf
            cut = np.partition(rough, n - 1)[n - 1]
            near = np.flatnonzero(rough <= cut + 1e-9 * (1 + abs(cut) + q @ q)) if np.isfinite(cut) else np.flatnonzero(np.isfinite(rough))
            exact = np.sqrt(((rows[near] - q) ** 2).sum(1))
            first = np.lexsort((row_ids[near], exact))[:k]
            out.append((np.full(len(first), i), order[near[first]], exact[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def valid_vectors(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v) of the rows that take part, whatever their length; single precision stays, other numbers become double."""
    single = vectors.schema[vec].dataType.simpleString() == "array<float>"
    v = F.col(vec) if single else F.transform(vec, lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & sound)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, len(flat) // max(1, rows))


def search(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", spec: PartitionSpec | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose key is divisible by ``every``."""
    spec = spec or PartitionSpec()
    spark = vectors.sparkSession
    ws = Workspace(spark, "partitions")
    rows = valid_vectors(vectors, key, vec)
    goal_parts = spec.parts_of(rows.count())
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(spec.sample_of(goal_parts)).toArrow()
    sizes = np.array([len(x) for x in sample["v"]], np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    x = np.array([r.as_py() for r, n in zip(sample["v"], sizes, strict=True) if n == dim], float).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(fit_router(x, spec, goal_parts))
    parts = len(shared.value.b2)
    is_query = F.col("id") % spec.every == 0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All partitions in order for queries, the first one for other rows."""
        for b in batches:
            ranked = shared.value.ranked(_matrix(b.column(1), b.num_rows), parts).astype(np.int32)
            asks = b.column(0).to_numpy() % spec.every == 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r if q else r[:1] for r, q in zip(ranked, asks, strict=True)], pa.list_(pa.int32()))], names=["id", "v", "parts"])

    kind = rows.schema["v"].dataType.simpleString()
    common = rows.where(F.size("v") == dim).mapInArrow(route, f"id long, v {kind}, parts array<int>")
    odd = rows.where(F.size("v") != dim).select("id", "v", F.array(-F.size("v")).alias("parts"))  # a partition for each other length
    placed = ws.save(common.union(odd), "placed")
    home = F.col("parts")[0]
    counts = {r[0]: r[1] for r in placed.groupBy(home.alias("part")).count().collect()}  # one row per partition
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = [n for p, n in counts.items() if p >= 0]
    least = np.cumsum(sorted([0] * (parts - len(held)) + held))
    enough = int(np.searchsorted(least, min(spec.k + 1, sum(held)))) + 1  # any so many partitions hold k candidates
    visits = min(parts, max(shared.value.visits, enough))
    goal = min(spec.most_chunk, max(spec.least_chunk, sum(counts.values()) // len(counts)))
    asks = placed.where(is_query).groupBy("id").agg(F.min(F.struct("v", "parts")).alias("q"))
    asks = asks.select("id", "q.v", F.explode(F.slice("q.parts", 1, visits)).alias("part")).where(F.col("part").isin([int(p) for p in counts]))
    asks = ws.save(asks, "asks")
    visitors = {r[0]: r[1] for r in asks.groupBy("part").count().collect()}  # one row per partition
    table = lambda found: F.create_map(*(F.lit(int(y)) for p in counts for y in (p, found(p))))
    chunks, blocks = table(lambda p: -(-counts[p] // goal)), table(lambda p: -(-visitors.get(p, 0) // spec.query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cell = F.xxhash64(*(F.col(c).cast("int") for c in ("part", "chunk", "block"))).alias("cell")
    stored = placed.select("id", "v", home.alias("part")).where(blocks[F.col("part")] > 0)
    stored = stored.select("id", "v", "part", F.pmod(F.xxhash64("id", F.lit(1)), chunks[F.col("part")]).alias("chunk"), spread(blocks[F.col("part")]).alias("block"))
    asked = asks.select("id", "v", "part", spread(chunks[F.col("part")]).alias("chunk"), F.pmod(F.xxhash64("id", F.lit(2)), blocks[F.col("part")]).alias("block"))
    both = stored.select(cell, F.lit(False).alias("asks"), "id", "v").union(asked.select(cell, F.lit(True).alias("asks"), "id", "v"))

    def rerank(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
        ids, v = t["id"].to_numpy(), _matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"], len(t))
        if not asks.any() or asks.all():
            q, r, d = np.empty(0, int), np.empty(0, int), np.empty(0)
        else:
            q, r, d = nearest_rows(v[asks], ids[asks], v[~asks], ids[~asks], spec.k)
        return pa.table({"query_id": pa.array(ids[asks][q], pa.int64()), "vec_id": pa.array(ids[~asks][r], pa.int64()), "score": pa.array(d, pa.float64())})

    found = both.groupBy("cell").applyInArrow(rerank, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")
