"""Indexes that are written once and asked by tables of queries, versions, and what stands in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.lexicon import LIMITS
from quarry.plans.index import payload, studies_of_payload
from quarry.plans.postings import Postings, write_postings
from quarry.plans.retrieve import RetrievalSpec, merge_many, retrieve_many
from quarry.plans.vector_index import VectorIndex, write_cells
from quarry.queries import records  # noqa: F401  its SQL is used here
from quarry.queries.base import ORACLE_SQL, query
from quarry.queries.retrieval import _ST, QUERY, _cos, _index, _overlap, _vectors
from quarry.runtime import Workspace
from quarry.sources.matrices import numbered_lines, scan_lines
from quarry.tables import table
from quarry.versions import VersionedTable


@query(f"select doc_id, {_overlap(QUERY)}::bigint as sparse_score, row_number() over (order by sparse_score desc, doc_id)::bigint as rank from documents where {_overlap(QUERY)} > 0 qualify rank <= 50")
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "postings")
    write_postings(table(spark, sf_dir, "documents"), ws.root, "doc_id", "text")
    out = Postings(spark, ws.root, "doc_id").top(QUERY, 50)
    return out.select("doc_id", F.col("sparse_score").cast("long").alias("sparse_score"), F.col("rank").cast("long").alias("rank"))


@query("""with t as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x != ''))) as token from documents) select token, count(*) as df from t group by token""")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "frequencies")
    write_postings(table(spark, sf_dir, "documents"), ws.root, "doc_id", "text")
    return Postings(spark, ws.root, "doc_id").tokens.select("token", "df")


@query(f"""with q as (select vec_id as query_id, embedding::double[] as qv from embeddings where label = 0), s as (select query_id, vec_id, {_cos('embedding::double[]', 'qv')} as score from q, embeddings where vec_id != query_id)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::bigint as rank from s qualify rank <= 5""")
def nearest_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every vector of a label, exactly, from cells that bounds leave open."""
    ws = Workspace(spark, "cells")
    e = table(spark, sf_dir, "embeddings")
    write_cells(e, ws.root, "vec_id", "embedding")
    asked = e.where("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    found = VectorIndex(spark, ws.root, "vec_id", "embedding").search(asked, 6).where("vec_id != query_id")
    rank = F.row_number().over(_by_score("query_id", "score", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where("rank <= 5").select("query_id", "vec_id", "score", "rank")


@query(ORACLE_SQL["ontology_nearest"])
def matched_in_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of another label above a threshold, from cells that may hold one."""
    ws = Workspace(spark, "match-cells")
    e = table(spark, sf_dir, "embeddings")
    write_cells(e.where("label != 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), ws.root, "id", "vec")
    asked = e.where("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return VectorIndex(spark, ws.root, "id", "vec").matches(asked, 0.3).select(F.col("query_id").alias("raw"), "id", "score")


def _by_score(group: str, score: str, key: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(group).orderBy(F.desc(score), key)


def _questions(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    """Benchmark passages as queries, with vectors of their numbers; every third asks for one language."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").join(v, "item_id").select(k.alias("query_id"), text.alias("query"), "vec", F.when(k % 3 == 0, "en").alias("lang"))


def _many(name: str, text: str) -> str:
    """SQL of the fused results of a table of questions, as a table of that name."""
    return f"""{name}_q as (select item_id as query_id, {text} as query, case when item_id % 3 = 0 then 'en' end as lang from benchmark),
{name}_v as (select query_id, lang, embedding::double[] as qv from {name}_q join embeddings on vec_id = query_id),
{name}_d as (select query_id, doc_id, {_cos('embedding::double[]', 'qv')} as dense_score, row_number() over (partition by query_id order by dense_score desc, doc_id) as rank from {name}_v q, embeddings join documents d on doc_id = vec_id where q.lang is null or q.lang = d.lang qualify rank <= 50),
{name}_w as (select query_id, unnest(list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x != ''))) as token from {name}_q),
{name}_o as (select query_id, doc_id, sum(tf)::int as sparse_score from {name}_w join tf using (token) group by all),
{name}_s as (select *, row_number() over (partition by query_id order by sparse_score desc, doc_id) as rank from {name}_o qualify rank <= 50),
{name}_f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as rrf, min(list * 1000 + rank) as tie, max(dense_score) as dense_score, max(sparse_score) as sparse_score
  from (select query_id, doc_id, rank, 0 as list, dense_score, null as sparse_score from {name}_d union all select query_id, doc_id, rank, 1, null, sparse_score from {name}_s) group by all),
{name} as (select *, row_number() over (partition by query_id order by round(rrf, 12) desc, tie, doc_id) as rank from {name}_f qualify rank <= 10)"""


_TF = "tf as (select doc_id, token, count(*) as tf from (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x != '')) as token from documents) group by all)"
_SHOWN = "query_id, doc_id, {r}.rank::bigint as rank, round({r}.rrf, 12) as rrf, coalesce(dense_score, 0)::double as dense_score, coalesce(sparse_score, 0)::bigint as sparse_score"


def _shown(found: DataFrame) -> DataFrame:
    zero = lambda c, t: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("rrf", 12).alias("rrf"), zero("dense_score", "double"), zero("sparse_score", "long"))


@query(f"with {_TF}, {_many('r', 'text')} select {_SHOWN.format(r='r')} from r")
def hybrid_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval for every benchmark passage, in one plan."""
    asked = _questions(spark, sf_dir, F.col("text"))
    return _shown(retrieve_many(_index(spark, sf_dir), asked, RetrievalSpec(strategy="hybrid+filter"), ["lang"], key="doc_id", vectors=_vectors(spark, sf_dir)))


@query(f"""with {_TF}, {_many('a', 'text')}, {_many('b', "split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")},
f as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as rrf, min(list * 1000 + rank) as tie from (select query_id, doc_id, rank, 0 as list from a union all select query_id, doc_id, rank, 1 from b) group by all),
m as (select query_id, doc_id, rrf, row_number() over (partition by query_id order by round(rrf, 12) desc, tie, doc_id) as rank from f qualify rank <= 10)
select m.query_id, m.doc_id, m.rank::bigint as rank, round(m.rrf, 12) as rrf, coalesce(case when a.doc_id is not null then a.dense_score else b.dense_score end, 0)::double as dense_score,
coalesce(case when a.doc_id is not null then a.sparse_score else b.sparse_score end, 0)::bigint as sparse_score from m left join a on a.query_id = m.query_id and a.doc_id = m.doc_id left join b on b.query_id = m.query_id and b.doc_id = m.doc_id""")
def refined_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage asked again with its first two words, and both results fused."""
    spec, index, vectors = RetrievalSpec(strategy="hybrid+filter"), _index(spark, sf_dir), _vectors(spark, sf_dir)
    words = F.split("text", " ")
    short = F.concat_ws(" ", words[0], F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    ws = Workspace(spark, "refined")
    write_postings(index, ws.root, "doc_id", "document_text")
    runs = []
    for name, text in (("first", F.col("text")), ("second", short)):
        found = retrieve_many(index, _questions(spark, sf_dir, text), spec, ["lang"], key="doc_id", vectors=vectors, postings=Postings(spark, ws.root, "doc_id"))
        runs.append(ws.save(found, name))
    return _shown(merge_many(*runs, "doc_id", 10))


@query(f"""with {_ST} select gse_id, case when s_suppkey % 2 = 0 then title || ' again' else title end as title, 2::bigint as versions from st where s_suppkey % 5 != 4 or s_suppkey % 2 = 0""")
def versioned_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by id on top of the first version, beside a write that breaks and leaves no version."""
    from quarry.queries.flows import _stored

    t = VersionedTable(spark, f"{Workspace(spark, 'versions').root}/t")
    rows = payload(_stored(spark, sf_dir)).select("gse_id", "title")
    number = F.substring("gse_id", 4, 20).cast("long")
    t.replace(rows.where(number % 5 != 4), "first")
    try:
        t.replace(rows.where(F.when(number >= 0, F.raise_error(F.lit("broken"))).isNull()))
    except Exception as e:
        if "broken" not in str(e):
            raise
    old = t.read()
    again = rows.where(number % 2 == 0).withColumn("title", F.concat("title", F.lit(" again")))
    t.replace(old.join(again.select("gse_id"), "gse_id", "left_anti").unionByName(again), "again")
    return t.read().withColumn("versions", F.lit(len(t.history())).cast("long"))


@query(f"""select doc_id, left(text, {LIMITS['document']}) as summary, left('doc ' || doc_id || chr(10) || text, {LIMITS['search_text']}) as document_text, 3::bigint as n_samples from documents""")
def payload_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored studies: long summaries and texts are cut, and what is stored is a study again."""
    empty = F.array().cast("array<string>")
    studies = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("GSE"), F.col("doc_id")).alias("gse_id"),
        F.concat(F.lit("doc "), F.col("doc_id")).alias("title"),
        F.col("text").alias("summary"),
        *(F.lit("").alias(c) for c in ("overall_design", "document_text", "organism", "platform", "series_type", "domain", "submission_date")),
        *(empty.alias(c) for c in ("modalities", "tissues", "diseases", "cell_types", "treatments")),
        F.lit(3).alias("n_samples"),
    )
    back = studies_of_payload(payload(studies, use_search_text=False))
    return back.select(F.substring("gse_id", 4, 20).cast("long").alias("doc_id"), "summary", "document_text", F.col("n_samples").cast("long").alias("n_samples"))


@query("select 'f' || o_orderkey % 3 as file, 'line ' || o_orderkey as value, row_number() over (partition by o_orderkey % 3 order by o_orderkey) - 1 as n from orders")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a few large files with their numbers, which are sums over the files' splits."""
    ws = Workspace(spark, "lines")
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey") % 3).alias("file"), "o_orderkey", F.concat(F.lit("line "), F.col("o_orderkey")).alias("value"))
    # files are what is tested here, so each is written by one task
    o.repartition("file").sortWithinPartitions("file", "o_orderkey").select("file", "value").write.partitionBy("file").text(f"{ws.root}/files")
    lines = ws.save(scan_lines(spark, f"{ws.root}/files"), "lines")
    return numbered_lines(lines).select(F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"), "value", F.col("n").cast("long").alias("n"))
