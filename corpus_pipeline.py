"""A training corpus from ``documents``: quality, near duplicates, personal data, mixing, packing.

Each stage gets what the one before it kept, as a table, and all but the last return the columns of ``documents``,
further ones with them, whatever their names. Every stage gives an empty result for an empty table and takes texts of
any length whole. What else is defined is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import compression_bands, mixing, packing, prefix_join, surrogates
from quarry.runtime import Workspace
from quarry.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their compression band.

    A null text is empty and goes, as all texts under ten words do; each row is judged alone, so copies stay or go together.
    """
    return compression_bands.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates.

    Rows that share a doc_id are one document: of several with different texts the one with the smallest hash stays.
    Documents without words have no copies and stay. A row without a doc_id stands for no group, so it stays.
    """
    first = prefix_join.near_duplicates(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").select(docs.columns)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    once = kept.withColumn("_nth_of_document", nth).where("_nth_of_document = 1").select(docs.columns)
    return once.union(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars, where it is given, follows the text.

    Null texts stay null, and so does their n_chars; equal texts get equal surrogates.
    """
    found = surrogates.replace_entities(docs)
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights ask for, once per epoch that takes them.

    Null levels of the tree count as empty ones; documents without words cost nothing and are taken once.
    """
    return mixing.mixed_documents(mixing.with_domain(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    A document that several epochs took has pieces for each of them, equal but for their place. An empty text is one
    piece, its end mark.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("pack", pack),
]

#: Compression, surrogates and tokens have no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
        ws.release()
    return docs
