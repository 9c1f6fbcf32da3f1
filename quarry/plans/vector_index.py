"""A vector index of cells around centres, kept beside the index of studies.

Unit vectors are dealt to the nearest of some centres, which are vectors of a bounded sample after a few rounds of means. Each
cell's folder holds its vectors, and a small table holds each centre with its cell's radius (the largest distance from
the centre). A search may visit the nearest cells only, with a recall that ``recall`` measures, or be exact: the distance from a query to a
centre, less the cell's radius, is never more than the distance to any vector of the cell (triangle inequality), so a second pass reads only the cells
that may still hold a better one than the k-th found. Cosine and distance of unit vectors order alike.

Defined cases: null and zero vectors, and such with null or non-finite components, aren't indexed and are similar to nothing; ties go to the smaller
key; an empty table has an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.vector import GUARD
from quarry.operators.ranking import top_per_group


@dataclass(frozen=True)
class CellSpec:
    """``sample``: vectors that centres are fitted to, at most; ``per_cell``: vectors that a cell holds on average."""

    sample: int = 20_000
    per_cell: int = 4096
    most_cells: int = 1024
    rounds: int = 8
    digits: int = 9


def _units(rows: list) -> np.ndarray:
    x = np.array(rows, float)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _usable(df: DataFrame, vec: str) -> DataFrame:
    v = F.col(vec).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False))).withColumn(vec, v)


def top_cosines(asked: pa.Table, held: pa.Table, k: int, query_id: str, key: str, vec: str, digits: int, by: list[str] | None = None) -> pa.Table:
    """(query_id, key, score) of the k most similar held vectors of each asked one (``_q``); ``by`` are values that have to agree."""
    if not len(asked) or not len(held):
        return pa.table({query_id: asked[query_id].slice(0, 0), key: held[key].slice(0, 0), "score": pa.array([], pa.float64())})
    held = held.sort_by(key)
    matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    q, v = matrix(asked, "_q"), matrix(held, vec)
    size = lambda x: np.sqrt((x * x).sum(1)) + GUARD
    few, rows, cols, scores, norms = min(k, len(v)), [], [], [], size(v)
    values = [(np.array(asked[f"_{c}"].to_pylist(), object), np.array(held[c].to_pylist(), object)) for c in by or []]
    for s in range(0, len(q), 256):
        some = q[s : s + 256]
        best_cos, best_col = np.empty((len(some), 0)), np.empty((len(some), 0), np.int64)
        for t in range(0, len(v), 8192):  # a product of 256 by 8192 at a time, and the best so far
            cos = np.round(some @ v[t : t + 8192].T / (size(some)[:, None] * norms[t : t + 8192]), digits)
            for want, has in values:
                w = want[s : s + 256]
                cos[np.array([x is not None for x in w])[:, None] & (w[:, None] != has[None, t : t + 8192])] = -np.inf
            n = min(few, cos.shape[1])
            least = np.partition(cos, cos.shape[1] - n, axis=1)[:, cos.shape[1] - n]
            high = cos >= least[:, None]  # with all ties of the last one, in order of keys
            above = cos > least[:, None]
            high &= above | (np.cumsum(high & ~above, axis=1, dtype=np.int32) <= (n - above.sum(1))[:, None])
            col = np.nonzero(high)[1].reshape(len(some), n)
            best_cos = np.hstack([best_cos, np.take_along_axis(cos, col, 1)])
            best_col = np.hstack([best_col, col + t])
            top = np.argsort(-best_cos, axis=1, kind="stable")[:, :few]  # earlier columns are smaller keys
            best_cos, best_col = np.take_along_axis(best_cos, top, 1), np.take_along_axis(best_col, top, 1)
        rows.append(np.repeat(np.arange(s, s + len(some)), best_col.shape[1]))
        cols.append(best_col.ravel())
        scores.append(best_cos.ravel())
    rows, cols, scores = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
    good = np.isfinite(scores)
    rows, cols = rows[good], cols[good]
    return pa.table({query_id: asked[query_id].take(pa.array(rows)), key: held[key].take(pa.array(cols)), "score": pa.array(scores[good])})


def dense_top_many(held: DataFrame, queries: DataFrame, k: int, key: str, vec: str, by: list[str] | None = None, digits: int = 9, chunk: int = 16_384, block: int = 16_384) -> DataFrame:
    """(query_id, key, dense_score, rank) of the k most similar vectors of each query (query_id, vec), all compared, without an index.

    Blocks of queries meet chunks of vectors as matrix products. Vectors of another length than the query's don't match it.
    """
    by = by or []
    v = _usable(held.where(F.col(vec).isNotNull()), vec).withColumn("dim", F.size(vec))
    q = _usable(queries.select("query_id", F.col("vec").alias("_q"), *(F.col(c).alias(f"_{c}") for c in by)), "_q").withColumn("dim", F.size("_q"))
    chunks, blocks = (max(1, -(-df.count() // size)) for df, size in ((held, chunk), (queries, block)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both sides' numbers are ints: a long is hashed to another partition, and a cogroup doesn't cast its keys.
    nth = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.select("*", nth("query_id", blocks).alias("block"), spread(chunks).alias("chunk"))
    right = v.select(key, vec, *by, F.col("dim").alias("d2"), nth(key, chunks).alias("k2"), spread(blocks).alias("b2"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"`query_id` {kind(queries, 'query_id')}, `{key}` {kind(held, key)}, score double"
    best = lambda asked, some: top_cosines(asked, some, k, "query_id", key, vec, digits, by)
    found = left.groupBy("dim", "block", "chunk").cogroup(right.groupBy("d2", "b2", "k2")).applyInArrow(best, schema)
    return top_per_group(found.withColumnRenamed("score", "dense_score"), ["query_id"], [F.desc("dense_score"), key], k)


def fit_centres(vectors: DataFrame, key: str, vec: str, spec: CellSpec, seed: int = 42) -> np.ndarray:
    """Means of a sample, the smallest hashes of keys; the sample and the centres are all that the driver sees."""
    total = vectors.count()
    cells = max(1, min(spec.most_cells, -(-total // spec.per_cell)))
    some = vectors.select(vec, F.xxhash64(F.col(key), F.lit(seed)).alias("h")).orderBy("h", vec).limit(spec.sample).collect()
    if not some:
        return np.empty((0, 0))
    x = _units([r[0] for r in some])
    centres = x[: min(cells, len(x))].copy()
    for _ in range(spec.rounds):
        own = (x @ centres.T).argmax(1)
        for i in range(len(centres)):
            if (own == i).any():
                m = x[own == i].mean(0)
                centres[i] = m / (np.sqrt(m @ m) or 1.0)
    return centres


def write_cells(vectors: DataFrame, path: str, key: str = "gse_id", vec: str = "vec", spec: CellSpec | None = None, keep: list[str] | None = None) -> None:
    """Vectors by cell below ``path``/cells, and ``path``/centres (cell, centre, radius, n); columns of ``keep`` stay beside the vectors."""
    spec, keep = spec or CellSpec(), keep or []
    spark = vectors.sparkSession
    rows = _usable(vectors.select(key, vec, *keep), vec)
    centres = fit_centres(rows, key, vec, spec)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            near = unit @ centres.T
            own = near.argmax(1)
            far = np.sqrt(((unit - centres[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(far)], names=[key, vec, *keep, "cell", "far"])

    more = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    dealt = rows.mapInArrow(run, f"`{key}` {kind}, `{vec}` array<double>{more}, cell int, far double")
    dealt.hint("rebalance", "cell").sortWithinPartitions("cell", key).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    facts = spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")
    schema = f"`{key}` {kind}, `{vec}` array<double>{more}, far double, cell int"
    sizes = spark.read.schema(schema).parquet(f"{path}/cells").groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    facts.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


class VectorIndex:
    """An index that ``write_cells`` has left below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "gse_id", vec: str = "vec", digits: int = 9):
        self.spark, self.key, self.vec, self.digits = spark, key, vec, digits
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most ``most_cells``
        self.cells = np.array([r.cell for r in rows], int)
        self.centres = np.array([r.centre for r in rows], float)
        self.radius = np.array([r.radius for r in rows], float)
        self.n = np.array([r.n for r in rows], int)
        self.rows = spark.read.parquet(f"{path}/cells") if rows else None

    def _visits(self, queries: DataFrame, query_id: str, vector: str, cells: int | None, k: int, bound: str | None = None, least_score: float | None = None, by: list[str] | None = None) -> DataFrame:
        """(query_id, vector, values of ``by``, cell): the nearest cells of each query, or with ``bound`` all that may hold a cosine above it and weren't visited.

        The nearest cells are as many as hold k vectors, and ``cells`` at least. With ``least_score`` they are all that may hold such a cosine.
        """
        by = by or []
        centres, radius, numbers, sizes = self.centres, self.radius, self.cells, self.n
        kind = queries.schema[query_id].dataType.simpleString()
        least = cells or 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                near = unit @ centres.T
                order = np.argsort(-near, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(numbers))[None, :], 1)
                enough = np.take_along_axis(np.cumsum(sizes[order], axis=1) - sizes[order], rank, 1) < k
                first = enough | (rank < least)
                if bound is not None:
                    limit = b.column(2).to_numpy(zero_copy_only=False)
                    to_centre = np.sqrt(np.maximum(0, 2 - 2 * near))
                    to_any = np.maximum(0, to_centre - radius[None, :] - 1e-7)
                    best = 1 - to_any**2 / 2  # the largest cosine that the cell can hold
                    first = ~first & (best >= limit[:, None] - 1e-7)
                elif least_score is not None:
                    to_any = np.maximum(0, np.sqrt(np.maximum(0, 2 - 2 * near)) - radius[None, :] - 1e-7)
                    first = 1 - to_any**2 / 2 >= least_score - 1e-7
                r, c = np.nonzero(first)
                with_values = [b.column(i) for i in (0, 1, *range(b.num_columns - len(by), b.num_columns))]
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(r)) for x in with_values), pa.array(numbers[c], pa.int32())], names=[query_id, "_q", *(f"_{x}" for x in by), "cell"])

        wanted = [F.col(query_id), F.col(vector).alias("_q"), *([F.col(bound)] if bound else []), *(F.col(c).alias(f"_{c}") for c in by)]
        more = "".join(f", `_{c}` {queries.schema[c].dataType.simpleString()}" for c in by)
        return _usable(queries.select(*wanted), "_q").mapInArrow(run, f"`{query_id}` {kind}, _q array<double>{more}, cell int")

    def _scored(self, visits: DataFrame, query_id: str, k: int, by: list[str] | None = None) -> DataFrame:
        """The k best of each (query, cell), as matrix products of one cell's chunk of vectors and the queries that visit it.

        Both sides of a cell are dealt over as many chunks as its size asks for, so no task holds more than one of each.
        """
        chunk, block, key, vec, digits = 16_384, 16_384, self.key, self.vec, self.digits
        counts = visits.groupBy("cell").agg(F.count("*").alias("asked"))
        chunks = self.spark.createDataFrame([(int(c), max(1, -(-int(n) // chunk))) for c, n in zip(self.cells, self.n, strict=True)], "cell int, chunks int")
        grid = chunks.join(counts, "cell").withColumn("blocks", F.ceil(F.col("asked") / block).cast("int"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        by = by or []
        left = visits.join(F.broadcast(grid), "cell").select(query_id, "_q", *(f"_{c}" for c in by), "cell", F.pmod(F.xxhash64(query_id), "blocks").cast("int").alias("block"), spread("chunks").alias("chunk"))
        right = self.rows.join(F.broadcast(grid), "cell").select(key, vec, *by, F.col("cell").alias("c2"), F.pmod(F.xxhash64(key), "chunks").cast("int").alias("k2"), spread("blocks").alias("b2"))

        best = lambda asked, held: top_cosines(asked, held, k, query_id, key, vec, digits, by)
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        schema = f"`{query_id}` {kind(visits, query_id)}, `{key}` {kind(self.rows, key)}, score double"
        return left.groupBy("cell", "block", "chunk").cogroup(right.groupBy("c2", "b2", "k2")).applyInArrow(best, schema)

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vec", cells: int | None = None) -> DataFrame:
        """(query_id, key, score, rank) of each query's k most similar vectors; exact, or from its ``cells`` nearest cells only."""
        kind = queries.schema[query_id].dataType.simpleString()
        if self.rows is None:
            return self.spark.createDataFrame([], f"`{query_id}` {kind}, `{self.key}` string, score double, rank int")
        first = self._scored(self._visits(queries, query_id, vector, cells, k), query_id, k)
        if cells is None:
            w = Window.partitionBy(query_id).orderBy(F.desc("score"), self.key)
            near = first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
            bounds = near.groupBy(query_id).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("_bound"))
            more = self._visits(queries.join(bounds, query_id), query_id, vector, None, k, "_bound")
            first = near.drop("_n").unionByName(self._scored(more, query_id, k))
        return top_per_group(first, [query_id], [F.desc("score"), self.key], k)

    def matches(self, queries: DataFrame, least: float, by: list[str] | None = None, query_id: str = "query_id", vector: str = "vec") -> DataFrame:
        """(query_id, key, score): each query's most similar vector of at least that cosine, exactly; ``by`` names columns that have to agree.

        Only cells that may hold such a vector are compared.
        """
        kind = queries.schema[query_id].dataType.simpleString()
        if self.rows is None:
            return self.spark.createDataFrame([], f"`{query_id}` {kind}, `{self.key}` string, score double")
        found = self._scored(self._visits(queries, query_id, vector, None, 1, least_score=least, by=by), query_id, 1, by)
        return top_per_group(found.where(F.col("score") >= least), [query_id], [F.desc("score"), self.key], 1).drop("rank")

    def recall(self, queries: DataFrame, k: int, cells: int, query_id: str = "query_id", vector: str = "vec") -> float:
        """Share of the exact results that ``cells`` cells find."""
        exact = self.search(queries, k, query_id, vector).select(query_id, self.key)
        found = self.search(queries, k, query_id, vector, cells).select(query_id, self.key)
        n = exact.count()
        return exact.join(found, [query_id, self.key], "left_semi").count() / n if n else 1.0
