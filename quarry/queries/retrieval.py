"""Retrieval, fusion, ordering and contexts. Documents are studies, embeddings their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.lexicon import LIMITS
from quarry.functions.text import truncate
from quarry.functions.vector import constant, cosine
from quarry.operators.lookup import expand_queries
from quarry.operators.ranking import budget_prefix, by_recency, max_marginal_relevance, merge_rankings, reciprocal_rank_fusion, sample_rows, top_k, top_per_group
from quarry.plans.answer import context_text, field_chunks, within_budget
from quarry.plans.index import index_info, search_text
from quarry.plans.retrieve import RetrievalSpec, dense_top, retrieve, sparse_top
from quarry.queries.base import query, quoted
from quarry.sources.records import study_by_id
from quarry.tables import table

QUERY = "the of and thing with"
OTHER = "la de que and to"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document_text"), "lang")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    got = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in got[0]]


def _in(words: str) -> str:
    return "(" + ", ".join(quoted(w) for w in sorted(set(words.split()))) + ")"


def _overlap(words: str, text: str = "text") -> str:
    return f"len(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x in {_in(words)}))"


def _cos(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-10) * (sqrt(list_dot_product({b}, {b})) + 1e-10)), 9)"


_ARMS = f"""q as (select embedding::double[] as qv from embeddings where vec_id = 0),
idx as (select d.doc_id, d.text, d.lang, e.embedding::double[] as vec from documents d left join embeddings e on e.vec_id = d.doc_id),
dense as (select *, row_number() over (order by s desc, doc_id) as rank from (select doc_id, {_cos('vec', 'qv')} as s from idx, q where vec is not null and lang = 'en') qualify rank <= 50),
sparse as (select *, row_number() over (order by c desc, doc_id) as rank from (select doc_id, {_overlap(QUERY)} as c from idx) where c > 0 qualify rank <= 50),
fused as (select doc_id, sum(1.0::double / (60 + rank)) as rrf, min(list * 1000 + rank) as tie from (select doc_id, rank, 0 as list from dense union all select doc_id, rank, 1 from sparse) group by doc_id),
ranked as (select doc_id, rrf, row_number() over (order by round(rrf, 12) desc, tie, doc_id) as rank from fused qualify rank <= 50)"""


@query(f"""with {_ARMS} select r.doc_id, r.rank::bigint as rank, round(r.rrf, 12) as rrf, coalesce(d.s, 0) as dense_score, coalesce(s.c, 0)::bigint as sparse_score
from ranked r left join dense d using (doc_id) left join sparse s using (doc_id) where r.rank <= 10""")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = RetrievalSpec(strategy="hybrid+filter")
    out = retrieve(_index(spark, sf_dir), QUERY, _vector(spark, sf_dir, 0), spec, {"lang": "en"}, key="doc_id", vectors=_vectors(spark, sf_dir))
    return out.select("doc_id", F.col("rank").cast("long").alias("rank"), F.round("rrf", 12).alias("rrf"), F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("sparse_score", F.lit(0)).cast("long").alias("sparse_score"))


_F1 = """case when len(p) = 0 and len(g) = 0 then 1.0 when len(p) = 0 or len(g) = 0 or len(list_intersect(p, g)) = 0 then 0.0
  else 2.0 * (len(list_intersect(p, g))::double / len(p)) * (len(list_intersect(p, g))::double / len(g)) / (len(list_intersect(p, g))::double / len(p) + len(list_intersect(p, g))::double / len(g)) end"""


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t != ''))"


@query(f"""with {_ARMS}, pg as (select r.doc_id, r.rank as before, {_tokens('i.text')} as p, {_tokens(quoted(QUERY))} as g from ranked r join idx i using (doc_id)),
scored as (select doc_id, before, round({_F1}, 9) as rerank_score from pg)
select doc_id, rerank_score, row_number() over (order by rerank_score desc, before)::bigint as rank from scored qualify rank <= 10""")
def rerank_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieve(_index(spark, sf_dir), QUERY, _vector(spark, sf_dir, 0), RetrievalSpec(), {"lang": "en"}, key="doc_id", vectors=_vectors(spark, sf_dir))
    return out.select("doc_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


@query(f"""with q as (select embedding::double[] as qv from embeddings where vec_id = 7)
select vec_id, {_cos('embedding::double[]', 'qv')} as dense_score, row_number() over (order by dense_score desc, vec_id)::bigint as rank from embeddings, q where label = 3 qualify rank <= 50""")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dense_top(table(spark, sf_dir, "embeddings").where("label = 3"), _vector(spark, sf_dir, 7), 50, "vec_id", "embedding")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"select doc_id, {_overlap(QUERY)}::bigint as sparse_score, row_number() over (order by sparse_score desc, doc_id)::bigint as rank from documents where {_overlap(QUERY)} > 0 qualify rank <= 50")
def sparse_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sparse_top(table(spark, sf_dir, "documents"), QUERY, 50, "doc_id", "text")
    return out.select("doc_id", F.col("sparse_score").cast("long").alias("sparse_score"), F.col("rank").cast("long").alias("rank"))


def _three(o: DataFrame) -> list[DataFrame]:
    return [top_k(o.withColumn("s", s), "s", "o_orderkey", 200).select("o_orderkey", "rank") for s in (F.col("o_totalprice"), F.unix_timestamp("o_orderdate"), F.pmod("o_orderkey", F.lit(997)))]


@query("""with a as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders qualify rank <= 200),
b as (select o_orderkey, row_number() over (order by epoch(o_orderdate)::bigint desc, o_orderkey) as rank from orders qualify rank <= 200),
c as (select o_orderkey, row_number() over (order by o_orderkey % 997 desc, o_orderkey) as rank from orders qualify rank <= 200)
select o_orderkey, round(sum(1.0::double / (60 + rank)), 12) as rrf from (from a union all from b union all from c) group by o_orderkey""")
def rrf_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = reciprocal_rank_fusion(_three(table(spark, sf_dir, "orders")), "o_orderkey")
    return fused.select("o_orderkey", F.round("rrf", 12).alias("rrf"))


@query(f"""with a as (select doc_id, {_overlap(QUERY)} as c, row_number() over (order by c desc, doc_id) as rank from documents where {_overlap(QUERY)} > 0 qualify rank <= 10),
b as (select doc_id, {_overlap(OTHER)} as c, row_number() over (order by c desc, doc_id) as rank from documents where {_overlap(OTHER)} > 0 qualify rank <= 10),
f as (select doc_id, sum(1.0::double / (60 + rank)) as rrf, min(list * 1000 + rank) as tie from (select doc_id, rank, 0 as list from a union all select doc_id, rank, 1 from b) group by doc_id),
r as (select doc_id, rrf, row_number() over (order by round(rrf, 12) desc, tie, doc_id) as rank from f qualify rank <= 10)
select r.doc_id, round(rrf, 12) as rrf, r.rank::bigint as rank, coalesce(a.c, b.c)::bigint as sparse_score from r left join a using (doc_id) left join b using (doc_id)""")
def multi_step_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = merge_rankings(sparse_top(d, QUERY, 10, "doc_id", "text"), sparse_top(d, OTHER, 10, "doc_id", "text"), "doc_id", 10)
    return out.select("doc_id", F.round("rrf", 12).alias("rrf"), F.col("rank").cast("long").alias("rank"), F.col("sparse_score").cast("long").alias("sparse_score"))


@query()
def mmr_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = constant(_vector(spark, sf_dir, 0))
    e = table(spark, sf_dir, "embeddings").withColumn("relevance", F.round(cosine(F.col("embedding"), asked), 9))
    few = top_per_group(e, ["label"], [F.desc("relevance"), "vec_id"], 50)
    return max_marginal_relevance(few, "label", "vec_id", "embedding", "relevance")


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as submission_date from orders order by submission_date desc, o_orderkey limit 25")
def recency_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("submission_date"))
    return by_recency(o, "submission_date", "o_orderkey").limit(25)


@query("""with s as (select p_type as id, p_name as syn, min(p_partkey) as pos from part group by all),
few as (select id, string_agg(syn, ' ' order by pos) as syns from (select *, row_number() over (partition by id order by pos) as n from s qualify n <= 3) group by id)
select p_partkey as query_id, p_name || ' ' || syns as expanded from part join few on id = p_type""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    onto = F.lit("UBERON").alias("onto")
    lookup = p.select(onto, F.lower("p_type").alias("key"), F.col("p_type").alias("id")).distinct()
    syns = p.groupBy(F.col("p_type").alias("id"), F.col("p_name").alias("syn")).agg(F.min("p_partkey").alias("pos")).withColumn("onto", F.lit("UBERON"))
    asked = p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"), F.concat(F.lit("\t "), F.upper("p_type"), F.lit(" ")).alias("tissue"))
    return expand_queries(asked, ["tissue"], lookup, syns).select("query_id", "expanded")


@query("""select conv_id, turn from (select conv_id, turn, sum(length(text)) over w as run, row_number() over w as n from conversations
window w as (partition by conv_id order by turn, text rows between unbounded preceding and current row)) where run <= 1200 or n = 1""")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return budget_prefix(c, F.length("text"), ["turn", "text"], 1200, ["conv_id"]).select("conv_id", "turn")


def _studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as studies."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    x = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    odd = F.col("s_suppkey") % 2 == 1
    some = lambda c, cond: F.when(cond, F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    return x.select(
        "s_suppkey",
        F.concat(F.lit("GSE"), F.col("s_suppkey")).alias("gse_id"),
        F.col("s_name").alias("title"),
        F.col("n_name").alias("organism"),
        F.when(odd, F.concat(F.lit("a summary of the supplies from "), "r_name")).otherwise("").alias("summary"),
        F.lit("").alias("overall_design"),
        F.lit("").alias("domain"),
        some("r_name", F.lit(True)).alias("modalities"),
        some("n_name", odd).alias("tissues"),
        some("r_name", F.col("s_suppkey") % 3 == 0).alias("diseases"),
        F.array().cast("array<string>").alias("cell_types"),
        F.array().cast("array<string>").alias("treatments"),
        F.pmod("s_suppkey", F.lit(4)).cast("int").alias("donor_count"),
        F.lit(None).cast("struct<pmid: string, title: string, abstract: string, mesh_terms: array<string>, keywords: array<string>>").alias("pubmed"),
        F.col("s_suppkey").alias("rank"),
    )


_ST = """st as (select s_suppkey, 'GSE' || s_suppkey as gse_id, s_name as title, n_name as organism, case when s_suppkey % 2 = 1 then 'a summary of the supplies from ' || r_name end as summary, r_name as modality,
  case when s_suppkey % 2 = 1 then n_name end as tissue, case when s_suppkey % 3 = 0 then r_name end as disease, s_suppkey % 4 as donors
  from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey)"""


@query(f"""with {_ST} select s_suppkey, concat_ws(chr(10), 'Study: ' || title, 'Organism: ' || organism, 'Summary: ' || summary, 'Modalities: ' || modality, 'Tissues: ' || tissue, 'Diseases: ' || disease,
case when donors > 0 then 'Donors: ' || donors end) as document_text from st""")
def search_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _studies(spark, sf_dir).select("s_suppkey", search_text().alias("document_text"))


@query(f"""with {_ST}, t as (select s_suppkey, '[' || s_suppkey || '] ' || gse_id || ': ' || title || chr(10) || '  Organism: ' || organism || ' | Tissues: ' || coalesce(tissue, '') || ' | Diseases: ' || coalesce(disease, '') || chr(10) as context from st)
select s_suppkey, context from (select *, sum(length(context)) over (order by s_suppkey) as run, row_number() over (order by s_suppkey) as n from t) where run <= 2000 or n = 1""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_budget(_studies(spark, sf_dir), 500).select("s_suppkey", context_text().alias("context"))


@query(f"""with {_ST} select gse_id, 'header' as chunk_type, gse_id || ': ' || title || ' | Organism: ' || organism || ' | Modalities: ' || modality as text from st
union all select gse_id, 'summary', gse_id || ' summary: ' || summary from st where length(summary) > 20
union all select gse_id, 'metadata', gse_id || ' metadata: ' || concat_ws(' | ', 'Tissues: ' || tissue, 'Diseases: ' || disease) from st where tissue is not null or disease is not null""")
def field_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_chunks(_studies(spark, sf_dir)).select("gse_id", "chunk_type", "text")


@query(f"select doc_id, left(text, {LIMITS['summary']}) || case when length(text) > {LIMITS['summary']} then '...' else '' end as preview from documents")
def truncate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), LIMITS["summary"], "...").alias("preview"))


@query("select count(*) as points_count, case when count(*) > 0 then 'green' else 'empty' end as status from embeddings")
def chat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_info(table(spark, sf_dir, "embeddings"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 7 limit 1")
def study_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = table(spark, sf_dir, "orders").withColumn("gse_id", F.col("o_orderkey").cast("string"))
    return study_by_id(studies, "7").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select doc_id, md5(doc_id || '42') as h from documents order by h, doc_id limit 200")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "documents"), "doc_id", 200).select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("42"))).alias("h"))
