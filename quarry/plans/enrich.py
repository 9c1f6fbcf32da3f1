"""Studies from series, samples and articles: characteristics, chains of fallbacks, derived fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.functions.text import first_number, norm_key, nullif_empty, strip
from quarry.operators.datasets import filled
from quarry.operators.rules import domain_first, modalities_in_order
from quarry.plans.index import search_text


def _family(key: Column) -> Column:
    found = F.when(F.lit(False), "")
    for family, keys in lexicon.CHARACTERISTIC_KEYS.items():
        found = found.when(key.isin(*keys), family)
    return found


#: Family of the row that stands for a sample itself.
_SAMPLE = "_sample"


def _pairs(samples: DataFrame, series: str, with_samples: bool = False) -> DataFrame:
    """(series, family, value) of samples, in one pass over them; with a row without value for each sample itself, if asked for."""
    pair = lambda family, value: F.struct(family.alias("family"), value.alias("value"))
    known = F.transform(F.map_entries("characteristics"), lambda e: pair(_family(norm_key(e["key"])), strip(e["value"])))
    known = F.filter(known, lambda p: p["family"].isNotNull() & (p["value"] != "") & ~F.lower(p["value"]).isin(*lexicon.NO_VALUE))
    source = F.when(~F.lower(F.coalesce("source", F.lit(""))).isin(*lexicon.NO_SOURCE), pair(F.lit("tissue"), F.col("source")))
    organism = F.when(F.col("organism") != "", pair(F.lit("organism"), F.col("organism")))
    own = [pair(F.lit(_SAMPLE), F.lit(None).cast("string"))] if with_samples else []
    some = F.filter(F.array(source, organism, *own), lambda p: p.isNotNull())
    return samples.select(series, F.explode(F.concat(F.coalesce(known, F.slice(some, 1, 0)), some)).alias("p")).select(series, "p.family", "p.value")


def long_characteristics(samples: DataFrame, series: str = "series_id") -> DataFrame:
    """(series, family, value): known characteristics with a value, and sample sources as tissues."""
    return _pairs(samples, series)


def summarize_characteristics(samples: DataFrame, series: str = "series_id") -> DataFrame:
    """Sorted distinct values of each family, number of donors and range of ages, one row per series."""
    return summarize_pairs(long_characteristics(samples, series), series)


def summarize_pairs(pairs: DataFrame, series: str = "series_id", *more: Column) -> DataFrame:
    of = lambda f, c=None: F.array_sort(F.collect_set(F.when(F.col("family") == f, F.lower("value") if c is None else c)))
    age = F.when(F.col("family") == "age", first_number(F.col("value")))
    low, high = F.min(age), F.max(age)
    return pairs.groupBy(series).agg(
        of("tissue").alias("tissues"),
        of("disease").alias("diseases"),
        of("cell_type").alias("cell_types"),
        of("treatment").alias("treatments"),
        of("organism", F.col("value")).alias("organisms"),
        of("sex").alias("sex"),
        F.size(F.collect_set(F.when(F.col("family") == "donor", F.col("value")))).alias("donor_count"),
        F.coalesce(F.concat_ws("-", low.cast("string"), high.cast("string")), F.lit("")).alias("age_range"),
        *more,
    )


def enrich(series: DataFrame, samples: DataFrame, articles: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Studies: series with sample summaries, the first article, and what the local manifest has where a field is blank.

    ``articles``: pmid, title, abstract, mesh_terms, keywords; ``manifest``: series_id, title, summary, series_type.
    """
    empty = F.array().cast("array<string>")
    # Samples are read once: their number comes with their terms.
    terms = summarize_pairs(_pairs(samples, "series_id", with_samples=True), "series_id", F.count_if(F.col("family") == _SAMPLE).cast("int").alias("_samples"))
    out = series.join(terms, "series_id", "left")
    if manifest is not None:
        m = manifest.select("series_id", *(F.col(c).alias(f"_m_{c}") for c in ("title", "summary", "series_type")))
        out = out.join(m, "series_id", "left")
        out = out.withColumns({c: filled(c, f"_m_{c}") for c in ("title", "summary", "series_type")})
    arrays = ("tissues", "diseases", "cell_types", "treatments", "organisms", "sex")
    out = out.withColumns({c: F.coalesce(c, empty) for c in arrays} | {"donor_count": F.coalesce("donor_count", F.lit(0)), "age_range": F.coalesce("age_range", F.lit(""))})
    out = out.withColumn("organism", F.coalesce(nullif_empty(F.col("organism")), F.get("organisms", F.lit(0)), F.lit("")))
    out = out.withColumn("n_samples", F.when(F.coalesce("n_samples", F.lit(0)) > 0, F.col("n_samples")).otherwise(F.coalesce("_samples", F.lit(0))))
    kind = "struct<pmid: string, title: string, abstract: string, mesh_terms: array<string>, keywords: array<string>>"
    if articles is not None:
        a = articles.select(F.col("pmid").alias("_pmid"), F.struct("pmid", "title", "abstract", "mesh_terms", "keywords").alias("pubmed"))
        out = out.join(a, F.get("pubmed_ids", F.lit(0)) == F.col("_pmid"), "left").drop("_pmid")
    else:
        out = out.withColumn("pubmed", F.lit(None).cast(kind))
    text = F.concat_ws(" ", "title", "summary")
    out = out.withColumns({"domain": domain_first(text), "modalities": modalities_in_order(F.col("series_type"), text), "gse_id": F.col("series_id")})
    drop = [c for c in out.columns if c.startswith("_")]
    return out.drop(*drop).withColumn("document_text", search_text())


def only_new(ids: DataFrame, done: DataFrame, key: str = "series_id") -> DataFrame:
    """Ids without an output yet."""
    return ids.join(done.select(key), key, "left_anti")


def study_mappings(studies: DataFrame, matched: DataFrame) -> DataFrame:
    """(gse_id, category, mappings in order of the study's own terms) from matches of distinct terms."""
    fields = F.array(*(F.struct(F.lit(c).alias("category"), F.col(n).alias("terms")) for c, n in (("tissue", "tissues"), ("disease", "diseases"), ("cell_type", "cell_types"))))
    long = studies.select("gse_id", F.explode(fields).alias("f")).select("gse_id", "f.category", F.posexplode("f.terms").alias("pos", "raw"))
    rows = long.join(matched, ["category", "raw"], "left")
    m = F.struct("pos", "raw", "id", "onto_name", "onto", "confidence", "method")
    return rows.groupBy("gse_id", "category").agg(F.array_sort(F.collect_list(m)).alias("mappings"))
