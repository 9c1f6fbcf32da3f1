"""Centroid clustering over integers, with centroids screened by block norms.

Vectors of ``dims`` finite components become integers floor(scale * x), x as double. Every round assigns each vector to the
nearest centroid by squared Euclidean distance and replaces the non-empty centroids by the componentwise floor of
their vectors' mean; all of it is exact.

A vector is kept with the norms of its ``blocks`` segments, its compressed form. For a segment, |x - c|^2 is at least
(|x| - |c|)^2 (Cauchy-Schwarz), so norms alone bound every distance from below. The centroid with the smallest bound is
measured first; only centroids whose bound isn't above that distance get exact integer distances. Bounds are lowered by more than
their rounding error, so a nearest centroid, and a tie, is never lost.

A round is one pass over the kept vectors. Each task adds up the integers of its vectors by centroid, so what is shuffled and
what the driver sees is one row per centroid and component (and task), whatever the rows; that bound is the number of
centroids times the components, and the centroids of a round travel with the code.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component take no part; ties go to the
smaller centroid; repeated rows count as often as they occur; first centroids with equal hashes (repeated vec_ids) are
ordered by their integers; rows without a vec_id have no hash, so they start no centroid before all others have; fewer
vectors than centroids give fewer centroids; an empty table gives an empty result; other columns, whatever their
names, are ignored. Components of 2^27 and more after scaling are an error, since a squared distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.runtime import Workspace


@dataclass(frozen=True)
class ClusterSpec:
    centroids: int = 40
    rounds: int = 5
    dims: int = 64
    scale: int = 256
    blocks: int = 8
    prefix: str = "2:"

    @property
    def edges(self) -> np.ndarray:
        """First component of each block."""
        return np.unique(np.arange(self.blocks) * self.dims // self.blocks)


LIMIT = 1 << 27


def block_norms(vectors: np.ndarray, spec: ClusterSpec) -> np.ndarray:
    """Norms of the segments of integer vectors."""
    return np.sqrt(np.add.reduceat(vectors.astype(float) ** 2, spec.edges, axis=1))


def lower_bounds(norms: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
    """(vectors x centroids) bounds that are never above the squared distance."""
    x, c = (norms**2).sum(1)[:, None], (of_centroids**2).sum(1)[None, :]
    return (x + c - 2 * norms @ of_centroids.T) - 1e-9 * (x + c) - 1e-6


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each vector, and how many exact distances it took."""
    bounds = lower_bounds(norms, of_centroids)
    rows = np.arange(len(vectors))
    first = bounds.argmin(1)
    known = ((vectors - centroids[first]) ** 2).sum(1)
    open_ = bounds <= known[:, None]
    open_[rows, first] = True
    r, c = np.nonzero(open_)
    exact = ((vectors[r] - centroids[c]) ** 2).sum(1)
    starts = np.flatnonzero(np.diff(r, prepend=-1))
    least = np.minimum.reduceat(exact, starts)
    at = np.flatnonzero(exact == least[r])  # in order of rows, then of centroids
    return c[at[np.flatnonzero(np.diff(r[at], prepend=-1))]], least, len(r)


def integers(vectors: DataFrame, key: str, column: str, spec: ClusterSpec) -> DataFrame:
    """key, x (integers) and norms of the vectors that take part."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), spec.dims), False))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, spec.dims)  # null components become NaN
            use = np.isfinite(x).all(1)
            scaled = np.floor(spec.scale * x[use])
            if scaled.size and np.abs(scaled).max() >= LIMIT:
                raise ValueError(f"a component is beyond {LIMIT} after scaling: squared distances would not fit a long")
            v = scaled.astype(np.int64)
            rows = lambda m, t: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), t), m.shape[1]).cast(pa.list_(t))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(use)), rows(v, pa.int32()), rows(block_norms(v, spec), pa.float64())], names=["key", "x", "norms"])

    return vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>")).mapInArrow(run, f"key {kind}, x array<int>, norms array<double>")


def _blocks(batches: Iterator[pa.RecordBatch], spec: ClusterSpec, size: int = 512) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            b = batch.slice(at, size)
            x = b.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, spec.dims)
            yield b.column(0), x, b.column(2).flatten().to_numpy().reshape(len(x), -1)


def _assigned(kept: DataFrame, centroids: np.ndarray, spec: ClusterSpec) -> DataFrame:
    norms = block_norms(centroids, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, x, n in _blocks(batches, spec):
            c, d, _ = nearest(x, n, centroids, norms)
            yield pa.RecordBatch.from_arrays([key, pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["key", "cluster", "distance"])

    return kept.mapInArrow(run, T.StructType([kept.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def _means(kept: DataFrame, centroids: np.ndarray, spec: ClusterSpec) -> np.ndarray:
    """Centroids of the next round."""
    norms = block_norms(centroids, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, x, n in _blocks(batches, spec):
            c = nearest(x, n, centroids, norms)[0]
            counts += np.bincount(c, minlength=len(counts))
            np.add.at(sums, c, x)
        for i in np.flatnonzero(counts):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array(counts[i : i + 1]), pa.array([sums[i].tolist()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = kept.mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = centroids.copy()
    for r in total.collect():  # one row per centroid and component
        new[r.cluster, r.at] = r.x // r.n
    return new


def fit(kept: DataFrame, spec: ClusterSpec) -> np.ndarray:
    """Final centroids for a table of ``integers``."""
    order = F.sha2(F.concat(F.lit(spec.prefix), F.col("key").cast("string")), 256)
    first = kept.select("x", order.alias("hash")).orderBy(F.asc_nulls_last("hash"), "x").limit(spec.centroids).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, spec.dims)
    for _ in range(spec.rounds if len(centroids) else 0):
        centroids = _means(kept, centroids, spec)
    return centroids


def cluster(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", spec: ClusterSpec | None = None) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 and the centroid of each vector that takes part."""
    spec = spec or ClusterSpec()
    spark = vectors.sparkSession
    ws = Workspace(spark, "block-norms")
    kept = ws.save(integers(vectors, key, column, spec), "kept")
    centroids = fit(kept, spec)
    found = ws.save(_assigned(kept, centroids, spec), "assigned") if len(centroids) else _assigned(kept, np.zeros((1, spec.dims), np.int64), spec)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row per centroid
    total = sum(sums.values())
    rows = [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def oracle(spec: ClusterSpec | None = None) -> str:
    """DuckDB SQL for ``cluster`` over ``embeddings``, without the centroids themselves."""
    spec = spec or ClusterSpec()
    ctes = [
        f"v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor({spec.scale} * cast(x as double)) as bigint)) as x, row_number() over () as r from embeddings"
        f" where len(embedding) = {spec.dims} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        f"h as (select x, row_number() over (order by sha256('{spec.prefix}' || vec_id) nulls last, x) - 1 as c from v)",
        f"c0 as materialized (select c, x from h where c < {spec.centroids})",
    ]
    for k in range(spec.rounds + 1):
        ctes.append(f"d{k} as (select v.r, c{k}.c, list_sum(list_transform(list_zip(v.x, c{k}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{k})")
        ctes.append(f"a{k} as materialized (select r, min_by(c, d * 1000 + c) as c, min(d) as d from d{k} group by r)")
        if k < spec.rounds:
            ctes.append(f"e{k} as (select a.c, unnest(range({spec.dims})) as i, unnest(v.x) as x from a{k} a join v on v.r = a.r)")
            ctes.append(f"m{k} as (select c, i, sum(x)::hugeint as s, count(*) as n from e{k} group by c, i)")
            ctes.append(f"n{k} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from m{k} group by c)")
            ctes.append(f"c{k + 1} as materialized (select c.c, coalesce(n.x, c.x) as x from c{k} c left join n{k} n on n.c = c.c)")
    k = spec.rounds
    return (
        "with " + ",\n".join(ctes) + f"\nselect v.vec_id, a.c::int as cluster, a.d as distance, (sum(a.d) over (partition by a.c))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia,"
        f" sha256(array_to_string(z.x, ',')) as centroid_sha256 from v join a{k} a on a.r = v.r join c{k} z on z.c = a.c"
    )
