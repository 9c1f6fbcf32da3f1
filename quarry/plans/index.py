"""The table of indexed studies: payload, encoding, replacing by id, point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.lexicon import LIMITS
from quarry.functions.text import nullif_empty, truncate
from quarry.providers import Providers


def labelled(label: str, value: Column) -> Column:
    """'Label: value', or null for nothing."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def _list(name: str) -> Column:
    return F.array_join(F.col(name), ", ")


def search_text() -> Column:
    """Text that a study is found by: labelled lines, empty ones left out."""
    pub = F.col("pubmed")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Study: "), "title"),
        F.concat(F.lit("Organism: "), "organism"),
        labelled("Summary", F.col("summary")),
        labelled("Design", F.col("overall_design")),
        labelled("Modalities", _list("modalities")),
        labelled("Domain", F.col("domain")),
        labelled("Tissues", _list("tissues")),
        labelled("Diseases", _list("diseases")),
        labelled("Cell types", _list("cell_types")),
        labelled("Treatments", _list("treatments")),
        F.when(F.col("donor_count") > 0, F.concat(F.lit("Donors: "), F.col("donor_count").cast("string"))),
        labelled("Abstract", pub["abstract"]),
        labelled("MeSH", F.array_join(pub["mesh_terms"], ", ")),
        labelled("Keywords", F.array_join(pub["keywords"], ", ")),
    )


def fallback_text() -> Column:
    """A study's own document text, else its title, summary and design."""
    return F.coalesce(nullif_empty(F.col("document_text")), F.concat_ws("\n", *(nullif_empty(F.col(c)) for c in ("title", "summary", "overall_design"))))


def payload(studies: DataFrame, use_search_text: bool = True) -> DataFrame:
    """Columns that are stored with a vector, long texts cut."""
    text = truncate(search_text() if use_search_text else fallback_text(), LIMITS["search_text"])
    plain = ("gse_id", "title", "organism", "platform", "series_type", "domain", "modalities", "n_samples", "submission_date", "tissues", "diseases", "cell_types", "treatments")
    return studies.select(*plain, truncate(F.col("summary"), LIMITS["document"]).alias("summary"), text.alias("document_text"), text.alias("search_text"))


def encode(studies: DataFrame, providers: Providers | None = None) -> DataFrame:
    return (providers or Providers()).encoder.column(studies, "document_text")


def write_index(indexed: DataFrame, path: str) -> None:
    """A new index; rows of one organism lie together, so that filters skip files."""
    indexed.repartitionByRange("organism", "gse_id").sortWithinPartitions("organism", "gse_id").write.mode("overwrite").parquet(path)


def upsert_index(spark: SparkSession, indexed: DataFrame, old: str, new: str) -> DataFrame:
    """Index at ``new``: the rows of ``old`` whose ids don't come again, and the new ones."""
    before = spark.read.parquet(old)
    kept = before.join(indexed.select("gse_id"), "gse_id", "left_anti")
    write_index(kept.unionByName(indexed.select(before.columns)), new)
    return spark.read.parquet(new)


def index_info(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("points_count")).withColumn("status", F.when(F.col("points_count") > 0, "green").otherwise("empty"))


def studies_of_payload(rows: DataFrame) -> DataFrame:
    """Stored rows as studies again: what the payload doesn't hold has its default, and extra columns such as scores stay."""
    held = set(rows.columns)
    empty = {"overall_design": F.lit(""), "donor_count": F.lit(0), "pubmed": F.lit(None).cast("struct<pmid: string, title: string, abstract: string, mesh_terms: array<string>, keywords: array<string>>")}
    text = ("gse_id", "title", "summary", "organism", "platform", "series_type", "domain", "submission_date", "document_text")
    lists = ("modalities", "tissues", "diseases", "cell_types", "treatments")
    named = {c: F.coalesce(F.col(c), F.lit("")) if c in held else F.lit("") for c in text}
    named |= {c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in held else F.array().cast("array<string>") for c in lists}
    named |= {"n_samples": F.coalesce(F.col("n_samples"), F.lit(0)) if "n_samples" in held else F.lit(0)}
    return rows.drop("search_text", "vec").withColumns(named | {c: v for c, v in empty.items() if c not in held})
