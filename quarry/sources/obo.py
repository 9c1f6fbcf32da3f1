"""Ontology files in OBO form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import strip

#: Files of the known ontologies, by lower-case name.
FILES = {"cl.obo": "CL", "uberon-basic.obo": "UBERON", "mondo.obo": "MONDO"}


def read_obo(spark: SparkSession, folder: str) -> DataFrame:
    """(onto, text) of the known files in a folder; others are left out."""
    name = F.lower(F.col("_metadata.file_name"))
    known = F.create_map(*(F.lit(x) for kv in FILES.items() for x in kv))
    rows = spark.read.text(folder, wholetext=True).select(F.try_element_at(known, name).alias("onto"), F.col("value").alias("text"))
    return rows.where("onto is not null")


def _after(lines: Column, prefix: str) -> Column:
    return F.transform(F.filter(lines, lambda x: x.startswith(prefix)), lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x)))


def parse_terms(texts: DataFrame) -> DataFrame:
    """(onto, id, name, synonyms, pos) of the terms that carry the ontology's prefix and aren't obsolete."""
    stanzas = F.split(F.regexp_replace("text", "\r\n", "\n"), r"(?m)^(?=\[[^\n]*\]$)")
    rows = texts.select("onto", F.posexplode(stanzas).alias("pos", "stanza")).where(F.col("stanza").startswith("[Term]\n"))
    rows = rows.withColumn("lines", F.split("stanza", "\n"))
    quoted = F.filter(F.transform(_after(F.col("lines"), "synonym: "), lambda s: F.regexp_extract(s, r'"([^"]*)"', 1)), lambda s: s != "")
    out = rows.select(
        "onto",
        strip(F.try_element_at(_after(F.col("lines"), "id: "), F.lit(-1))).alias("id"),
        strip(F.try_element_at(_after(F.col("lines"), "name: "), F.lit(-1))).alias("name"),
        quoted.alias("synonyms"),
        F.exists("lines", lambda x: x.startswith("is_obsolete: true")).alias("obsolete"),
        "pos",
    )
    out = out.where("id != '' and name != '' and not obsolete").where(F.col("id").startswith(F.col("onto")))
    return out.groupBy("onto", "id").agg(F.max_by(F.struct("name", "synonyms"), "pos").alias("t"), F.min("pos").alias("pos")).select("onto", "id", "t.name", "t.synonyms", "pos")


def synonyms_of(terms: DataFrame) -> DataFrame:
    """(onto, id, syn, pos) in order of terms and of their synonyms."""
    long = terms.select("onto", "id", F.col("pos").alias("tpos"), F.posexplode("synonyms").alias("spos", "syn"))
    return long.select("onto", "id", "syn", (F.col("tpos").cast("long") * 1_000_000 + F.col("spos")).alias("pos"))


def entry_text(name: Column, synonyms: Column) -> Column:
    """Text to encode a term by: its name and at most five synonyms."""
    few = F.slice(synonyms, 1, 5)
    return F.when(F.size(synonyms) > 0, F.concat(name, F.lit(": "), F.array_join(few, ", "))).otherwise(name)
