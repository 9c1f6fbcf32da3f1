"""An inverted index of texts: which document holds which token how often.

Postings lie in folders by a hash of their token, in order of token and key, so that a query reads the folders of its own tokens and in them
the row groups that its tokens fall into; texts are tokenized once, when they are indexed. A token that a large share of all
documents holds is dealt over several files of its folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.ranking import top_k, top_per_group


#: Tokens of a table of queries that every executor may hold.
_FEW_WORDS = 200_000


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key, tf) of each document's tokens; repeated keys are one document.

    Texts are dealt by key once, and their tokens are counted where they lie: a text is shuffled, never its tokens.
    """
    dealt = docs.select(key, F.col(text).alias("_text")).repartition(key)
    rows = dealt.select(key, F.explode(tokens(F.col("_text"))).alias("token"))
    return rows.groupBy("token", key).agg(F.count("*").alias("tf"))


def write_postings(docs: DataFrame, path: str, key: str = "gse_id", text: str = "document_text", buckets: int = 64) -> None:
    """Postings below ``path``/postings and document frequencies in ``path``/tokens, which also names the number of buckets."""
    rows = postings(docs, key, text).withColumn("bucket", bucket_of(F.col("token"), buckets))
    # Spark splits what is too large for one task, and each task writes sorted files.
    dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    kept = docs.sparkSession.read.parquet(f"{path}/postings")
    df = kept.groupBy("token").agg(F.count("*").alias("df"))
    df.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/tokens")


class Postings:
    """An index that ``write_postings`` has left below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "gse_id"):
        self.key, self.rows, self.tokens = key, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/tokens")
        first = self.tokens.select("buckets").first()
        self.buckets = first.buckets if first else 1

    def of(self, words: list[str]) -> DataFrame:
        """(token, key, tf) of some tokens, from their own buckets only."""
        spark = self.rows.sparkSession
        some = sorted(set(words))
        if not some:
            return self.rows.limit(0).drop("bucket")
        ids = spark.createDataFrame([(w,) for w in some], "token string").select("token", bucket_of(F.col("token"), self.buckets).alias("bucket")).collect()  # a query's tokens
        return self.rows.where(F.col("bucket").isin(sorted({r.bucket for r in ids})) & F.col("token").isin(some)).drop("bucket")

    def top(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """(key, sparse_score, rank) of the documents in which the query's tokens occur most; ``among`` (key) restricts them."""
        rows = self.of(query.lower().split())
        rows = rows if among is None else rows.join(among, self.key, "left_semi")
        scores = rows.groupBy(self.key).agg(F.sum("tf").cast("int").alias("sparse_score"))
        return top_k(scores, "sparse_score", self.key, k)

    def top_many(self, queries: DataFrame, k: int, facts: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
        """(query_id, key, sparse_score, rank) of the best documents of every query (query_id, query), in one plan.

        The postings of the queries' tokens are dealt by key, so that they meet the queries and are summed where their document lies.
        """
        words = query_tokens(queries, by).withColumn("bucket", bucket_of(F.col("token"), self.buckets))
        words, asked = _few(words, ["bucket", "token"])
        rows = self.rows.join(asked, ["bucket", "token"], "left_semi")
        rows = rows.repartition(self.key) if not by else rows.join(facts, self.key).repartition(self.key)
        return _best(words, rows, ["bucket", "token"], self.key, k, by)


def query_tokens(queries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(query_id, token, values to filter by): a query's distinct tokens."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"), *(F.col(c).alias(f"_{c}") for c in by or []))


def _few(words: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """``words`` and their distinct ``on``, sent to every executor if they are few."""
    asked = words.select(*on).distinct()
    return (words, asked) if words.limit(_FEW_WORDS + 1).count() > _FEW_WORDS else (F.broadcast(words), F.broadcast(asked))


def _best(words: DataFrame, rows: DataFrame, on: list[str], key: str, k: int, by: list[str] | None) -> DataFrame:
    met = words.join(rows, on)
    for c in by or []:
        met = met.where(F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
    scores = met.groupBy("query_id", key).agg(F.sum("tf").cast("int").alias("sparse_score"))
    return top_per_group(scores, ["query_id"], [F.desc("sparse_score"), key], k)


def sparse_top_many(index: DataFrame, queries: DataFrame, k: int, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """As ``Postings.top_many`` from the texts themselves; tokens that no query has leave before anything is shuffled."""
    words, asked = _few(query_tokens(queries, by), ["token"])
    # Texts are dealt by key once: tokens are counted, met and summed where their text lies, and only the best of each task are shuffled.
    dealt = index.select(key, *(by or []), F.col(text).alias("_text")).repartition(key)
    some = dealt.select(key, *(by or []), F.explode(tokens(F.col("_text"))).alias("token")).join(asked, "token", "left_semi")
    return _best(words, some.groupBy("token", key, *(by or [])).agg(F.count("*").alias("tf")), ["token"], key, k, by)
