"""Line-oriented series and sample records (SOFT text), one text per series.

Records are parsed with array functions inside the row that holds the text, so nothing is shuffled and line order,
on which several fields depend, needs no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import after, before, nullif_empty, strip


def read_texts(spark: SparkSession, path: str, id_pattern: str = r"(GSE\d+)") -> DataFrame:
    """(series_id, text) from landed files, one per series, named after it."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.upper(F.regexp_extract(F.col("_metadata.file_name"), f"(?i){id_pattern}", 1)).alias("series_id"), F.col("value").alias("text"))


def lines_of(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), strip)


def values_of(lines: Column, prefix: str) -> Column:
    """Values after '=' of the lines that start with ``prefix``, in order."""
    return F.transform(F.filter(lines, lambda x: x.startswith(prefix)), lambda x: after(x, "="))


def last(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))


def parse_series(texts: DataFrame, text: str = "text") -> DataFrame:
    """Series fields: last title, organism, platform and date; joined summary, design and types; distinct ids in order.

    The sample count is order-aware: a count line sets it, each later sample line adds one.
    """
    lines = lines_of(F.col(text))
    some = lambda p: F.filter(values_of(F.col("_lines"), p), lambda v: v != "")
    marked = F.transform("_lines", lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    number = lambda x: after(x, "=").try_cast("int")
    counts = F.filter(marked, lambda m: m["line"].startswith("!Series_sample_count") & number(m["line"]).isNotNull())
    lastc = F.try_element_at(counts, F.lit(-1))
    later = F.filter(marked, lambda m: m["line"].startswith("!Series_sample_id") & (m["at"] > F.coalesce(lastc["at"], F.lit(-1))))
    out = texts.withColumn("_lines", lines)
    return out.withColumns(
        {
            "title": last(values_of(F.col("_lines"), "!Series_title")),
            "summary": F.array_join(some("!Series_summary"), " "),
            "overall_design": F.array_join(some("!Series_overall_design"), " "),
            "organism": last(values_of(F.col("_lines"), "!Series_sample_organism")),
            "series_type": F.array_join(some("!Series_type"), "; "),
            "platform": last(values_of(F.col("_lines"), "!Series_platform_id")),
            "pubmed_ids": F.array_distinct(some("!Series_pubmed_id")),
            "submission_date": last(values_of(F.col("_lines"), "!Series_submission_date")),
            "n_samples": F.coalesce(number(lastc["line"]), F.lit(0)) + F.size(later),
        }
    ).drop("_lines", text)


def _labelled(x: Column) -> Column:
    return (F.instr(x, ": ") > 0) | ((F.instr(x, "=") > 0) & ~x.startswith("!"))


def _entries(raw: Column) -> Column:
    def entry(x: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(raw, F.lit(1), i), lambda y: ~_labelled(y)))
        key = F.when(F.instr(x, ": ") > 0, F.lower(before(x, ": "))).when(_labelled(x), F.lower(before(x, "="))).otherwise(F.concat(F.lit("attr_"), n.cast("string")))
        value = F.when(F.instr(x, ": ") > 0, after(x, ": ")).when(_labelled(x), after(x, "=")).otherwise(x)
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(raw, entry)


def _last_of_each(entries: Column, keys: Column) -> Column:
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(-1))["value"]))


def with_characteristics(rows: DataFrame, raw: Column, out: str = "characteristics") -> DataFrame:
    """``rows`` with a map of sample characteristics: 'key: value', else 'key=value', else attr_n; a later key wins.

    Each step is a column of its own, since Spark evaluates anew what stands inside another step's lambda, once for each element.
    """
    rows = rows.withColumn("_raw", raw).withColumn("_entries", _entries(F.col("_raw")))
    rows = rows.withColumn("_keys", F.array_distinct(F.transform("_entries", lambda e: e["key"])))
    return rows.withColumn(out, _last_of_each(F.col("_entries"), F.col("_keys"))).drop("_raw", "_entries", "_keys")


def parse_samples(texts: DataFrame, series: str = "series_id", text: str = "text") -> DataFrame:
    """One row per sample section; of sections with one id the last wins."""
    parts = F.filter(F.split(F.col(text), r"(?m)^[ \t]*(?=\^SAMPLE)"), lambda s: s.startswith("^SAMPLE"))
    rows = texts.select(series, F.posexplode(parts).alias("pos", "section")).withColumn("_lines", lines_of(F.col("section")))
    get = lambda p: last(values_of(F.col("_lines"), p))
    rows = with_characteristics(rows, values_of(F.col("_lines"), "!Sample_characteristics_ch1")).select(
        series,
        "pos",
        after(F.get("_lines", F.lit(0)), "=").alias("sample_id"),
        get("!Sample_title").alias("title"),
        get("!Sample_source_name_ch1").alias("source"),
        get("!Sample_organism_ch1").alias("organism"),
        get("!Sample_platform_id").alias("platform"),
        "characteristics",
        F.filter(values_of(F.col("_lines"), "!Sample_supplementary_file"), lambda v: (v != "") & (F.lower(v) != "none")).alias("supplementary_files"),
    ).where("sample_id != ''")
    names = [c for c in rows.columns if c not in (series, "sample_id")]
    best = rows.groupBy(series, "sample_id").agg(F.max_by(F.struct(*names), "pos").alias("s"))
    return best.select(series, "sample_id", "s.*")


def supplementary_urls(texts: DataFrame, series: str = "series_id", text: str = "text") -> DataFrame:
    """(series_id, pos, url) of sample-level files; lines without a value or with 'none' are dropped."""
    urls = F.filter(values_of(F.filter(lines_of(F.col(text)), lambda x: F.instr(x, "=") > 0), "!Sample_supplementary_file"), lambda v: (v != "") & (F.lower(v) != "none"))
    return texts.select(series, F.posexplode(urls).alias("pos", "url"))


def select_accessions(ids: DataFrame, column: str = "id") -> DataFrame:
    """Valid series accessions: trimmed, upper case, distinct."""
    x = ids.select(F.upper(strip(F.col(column))).alias("series_id"))
    return x.where(nullif_empty(F.col("series_id")).startswith("GSE")).distinct()
