"""Hybrid retrieval as one lazy plan: dense and sparse arms, fusion, reranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.lexicon import RERANK_K, RRF_K, TOP_K
from quarry.functions.text import tokens
from quarry.functions.vector import constant, cosine
from quarry.operators.ranking import fuse, merge_rankings, top_k, top_per_group
from quarry.plans.postings import Postings, sparse_top_many
from quarry.plans.vector_index import VectorIndex, dense_top_many
from quarry.providers import Providers


@dataclass(frozen=True)
class RetrievalSpec:
    """The strategy's words switch arms on: dense, sparse or hybrid, with filter and rerank.

    ``filter_scope`` is 'dense' (only the dense arm is filtered) or 'both'.
    """

    strategy: str = "hybrid+filter+rerank"
    top_k: int = TOP_K
    rerank_k: int = RERANK_K
    rrf_k: int = RRF_K
    filter_scope: str = "dense"
    digits: int = 9


def equality(filters: dict[str, object] | None) -> Column:
    hit = F.lit(True)
    for name, value in (filters or {}).items():
        hit = hit & (F.col(name) == F.lit(value))
    return hit


def dense_top(index: DataFrame, query: list[float], k: int, key: str = "gse_id", vec: str = "vec", digits: int = 9) -> DataFrame:
    """(key, dense_score, rank) of the nearest vectors; only key and score leave the scan. Zero vectors, asked or stored, are near to nothing."""
    some = F.exists(vec, lambda x: x != 0) if any(query) else F.lit(False)
    scored = index.where(F.col(vec).isNotNull() & some).select(key, F.round(cosine(F.col(vec), constant(query)), digits).alias("dense_score"))
    return top_k(scored, "dense_score", key, k)


def overlap(text: Column, query: str) -> Column:
    """How often tokens of the query occur in the text."""
    wanted = F.array(*(F.lit(t) for t in sorted(set(query.lower().split())))) if query.split() else F.array().cast("array<string>")
    return F.size(F.filter(tokens(text), lambda t: F.array_contains(wanted, t)))


def sparse_top(index: DataFrame, query: str, k: int, key: str = "gse_id", text: str = "document_text") -> DataFrame:
    """(key, sparse_score, rank) of the texts that share most tokens with the query; none without any."""
    scored = index.select(key, overlap(F.col(text), query).alias("sparse_score")).where("sparse_score > 0")
    return top_k(scored, "sparse_score", key, k)


def retrieve(index: DataFrame, query: str, vector: list[float], spec: RetrievalSpec | None = None, filters: dict[str, object] | None = None, providers: Providers | None = None, key: str = "gse_id", text: str = "document_text", vec: str = "vec", vectors: DataFrame | None = None, postings: Postings | None = None) -> DataFrame:
    """Rows of the index with rank, dense_score, sparse_score, rrf and rerank_score, best first by rank.

    Each arm ranks keys and scores alone; rows of the index are fetched for the fused keys only. ``vectors`` (key, vec) may stand apart
    from the index, and ``postings`` may stand for its texts in the sparse arm.
    """
    spec, providers = spec or RetrievalSpec(), providers or Providers()
    s = spec.strategy
    use_dense, use_sparse = "dense" in s or "hybrid" in s, "sparse" in s or "hybrid" in s or not ("dense" in s)
    filtered = "filter" in s and bool(filters)
    hit = equality(filters) if filtered else F.lit(True)
    arms = []
    if use_dense:
        some = index.where(hit) if vectors is None else vectors.join(index.where(hit).select(key), key, "left_semi") if filtered else vectors
        arms.append(dense_top(some, vector, spec.top_k, key, vec, spec.digits))
    if use_sparse:
        within = filtered and spec.filter_scope == "both"
        if postings is None:
            arms.append(sparse_top(index.where(hit) if within else index, query, spec.top_k, key, text))
        else:
            arms.append(postings.top(query, spec.top_k, index.where(hit).select(key) if within else None))
    out = fuse(arms, key, spec.top_k, spec.rrf_k, ["dense_score", "sparse_score"])
    if len(arms) == 1:
        out = out.withColumn("rrf", F.lit(None).cast("double"))
    kinds = {"dense_score": "double", "sparse_score": "int"}
    out = out.withColumns({c: F.col(c).cast(kinds[c]) for c in kinds}).join(index.drop("rank"), key)
    if "rerank" in s and providers.reranker is not None:
        out = out.withColumn("rerank_score", F.round(providers.reranker.score(query, F.col(text)), spec.digits))
        return top_k(out.withColumnRenamed("rank", "_rank").withColumn("_tie", -F.col("_rank")), "rerank_score", "_rank", spec.rerank_k).drop("_rank", "_tie")
    return out.withColumn("rerank_score", F.lit(None).cast("double")).where(F.col("rank") <= spec.rerank_k)


def multi_step(index: DataFrame, query: str, spec: RetrievalSpec | None = None, refine=None, filters: dict[str, object] | None = None, providers: Providers | None = None, key: str = "gse_id", title: str = "title", least: int = 5) -> DataFrame:
    """Retrieve, let ``refine(query, titles)`` rewrite the query from the first five titles, retrieve again and merge."""
    spec, providers = spec or RetrievalSpec(), providers or Providers()
    run = lambda q: retrieve(index, q, providers.encoder.encode(q), spec, filters, providers, key)
    first = run(query)
    if refine is None:
        return first
    titles = [r[0] for r in first.where("rank <= 5").orderBy("rank").select(title).collect()]
    if not titles:
        return first
    try:
        refined = (refine(query, titles) or "").strip()
    except Exception:  # a refinement that fails leaves the first results
        return first
    return first if len(refined) < least else merge_rankings(first.drop("rrf"), run(refined).drop("rrf"), key, spec.rerank_k)


def search(index: DataFrame, query: str, parsed: dict[str, str], spec: RetrievalSpec | None = None, providers: Providers | None = None, postings: Postings | None = None) -> DataFrame:
    """Retrieval filtered by the organism of a parsed query."""
    spec, providers = spec or RetrievalSpec(), providers or Providers()
    if providers.reranker is None:
        spec = replace(spec, strategy=spec.strategy.replace("+rerank", ""))
    filters = {"organism": parsed["organism"]} if parsed.get("organism") else None
    text = parsed.get("free_text") or query
    return retrieve(index, text, providers.encoder.encode(text), spec, filters, providers, postings=postings)


def retrieve_many(index: DataFrame, queries: DataFrame, spec: RetrievalSpec | None = None, filters: list[str] | None = None, providers: Providers | None = None, key: str = "gse_id", text: str = "document_text", vec: str = "vec", vectors: DataFrame | None = None, postings: Postings | None = None, cells: VectorIndex | None = None) -> DataFrame:
    """(query_id, key, rank, dense_score, sparse_score, rrf, rerank_score) for a table of queries (query_id, query, vec), in one plan.

    The same results as ``retrieve`` gives for each query. ``filters`` name columns of both tables: a query's value, where it isn't null,
    is asked of the dense arm (with ``filter_scope='both'`` of both arms). Rows of the index are read only for texts that are reranked.
    """
    spec, providers = spec or RetrievalSpec(), providers or Providers()
    s, group = spec.strategy, ["query_id"]
    use_dense, use_sparse = "dense" in s or "hybrid" in s, "sparse" in s or "hybrid" in s or not ("dense" in s)
    by = list(filters or []) if "filter" in s else []
    facts = index.select(key, *by)
    arms = []
    if use_dense:
        held = (index if vectors is None else vectors).select(key, vec)
        if by:
            held = index.select(key, vec, *by) if vectors is None else held.join(facts, key)
        if cells is not None and not by:
            arms.append(cells.search(queries, spec.top_k, "query_id", "vec").withColumnRenamed("score", "dense_score"))
        else:
            arms.append(dense_top_many(held, queries, spec.top_k, key, vec, by, spec.digits))
    if use_sparse:
        within = by if spec.filter_scope == "both" else []
        arms.append(sparse_top_many(index, queries, spec.top_k, key, text, within) if postings is None else postings.top_many(queries, spec.top_k, facts if within else None, within))
    out = fuse(arms, key, spec.top_k, spec.rrf_k, ["dense_score", "sparse_score"], group)
    if len(arms) == 1:
        out = out.withColumn("rrf", F.lit(None).cast("double"))
    kinds = {"dense_score": "double", "sparse_score": "int"}
    out = out.withColumns({c: F.col(c).cast(kinds[c]) for c in kinds})
    columns = ["query_id", key, "rank", *kinds, "rrf"]
    if "rerank" not in s or providers.reranker is None:
        return out.where(F.col("rank") <= spec.rerank_k).select(*columns, F.lit(None).cast("double").alias("rerank_score"))
    read = out.join(index.select(key, F.col(text).alias("_text")), key).join(queries.select("query_id", F.col("query").alias("_query")), "query_id")
    scored = read.withColumn("rerank_score", F.round(providers.reranker.score(F.col("_query"), F.col("_text")), spec.digits)).withColumnRenamed("rank", "_rank")
    return top_per_group(scored, group, [F.desc("rerank_score"), "_rank"], spec.rerank_k).select(*columns, "rerank_score")


def merge_many(first: DataFrame, second: DataFrame, key: str, keep: int) -> DataFrame:
    """Two result tables of ``retrieve_many`` fused query by query; a row that both have is taken from the first one."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    once = top_per_group(both, ["query_id", key], ["_from", "rank"], 1, "_nth").drop("_from", "_nth", "rank", "rrf")
    return fuse([first, second], key, keep, group=["query_id"]).join(once, ["query_id", key])
