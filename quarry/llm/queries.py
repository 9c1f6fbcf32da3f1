"""Queries of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import (
    block_norms,
    compression_bands,
    golay_hash,
    html_nodes,
    html_training,
    learned_partitions,
    minimax_shards,
    mixing,
    packing,
    prefix_join,
    secrets,
    surrogates,
    token_alignment,
    toxicity,
)
from quarry.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return surrogates.replace_entities(docs.select("doc_id", "text"), count="n_mentions")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(mixing.with_domain(table(spark, sf_dir, "documents")))


def op7_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.judge(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_nodes.extract(table(spark, sf_dir, "pages"), html_training.train_node_model())


def op9_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards.shard_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_figures(table(spark, sf_dir, "documents"))


def op12_block_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_norms.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_golay_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_hash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_secret_scan,
        op3_learned_partitions,
        op4_pii_surrogates,
        op5_best_fit_packing,
        op6_mixing,
        op7_compression_bands,
        op8_html_extraction,
        op9_minimax_shards,
        op10_toxicity,
        op11_token_alignment,
        op12_block_norms,
        op13_golay_hash,
    )
}

_NEAR_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as shingles from w),
n as (select doc_id, len(shingles) as n from s),
t as (select doc_id, unnest(shingles) as shingle from s),
c as (select a.doc_id as x, b.doc_id as y, count(*) as c from t a join t b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r(x, y) as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(min(r.y), n.doc_id)) as component_id from n left join r on r.x = n.doc_id group by n.doc_id, n.n"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": _NEAR_SQL, "op6_mixing": mixing.oracle(), "op12_block_norms": block_norms.oracle()}
