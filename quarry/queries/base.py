"""Registry of queries and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def case_sql(x: str, rules: Iterable[tuple[str, str]], default: str = "unknown") -> str:
    whens = " ".join(f"when regexp_matches({x}, {quoted('(?i)' + p)}) then {quoted(v)}" for p, v in rules)
    return f"case {whens} else {quoted(default)} end"


def words_sql(x: str, groups: Iterable[tuple[str, Iterable[str]]], default: str) -> str:
    whens = " ".join(f"when {' or '.join(f'contains({x}, {quoted(w)})' for w in ws)} then {quoted(v)}" for v, ws in groups)
    return f"case {whens} else {quoted(default)} end"


def any_sql(x: str, patterns: Iterable[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({x}, {quoted('(?i)' + p)})" for p in patterns) + ")"


#: Endings of file names that orders stand for.
SUFFIXES = (
    "_data.h5ad", "_filtered_feature_bc_matrix.h5", "_raw_feature_bc_matrix.h5", "_filtered_peak_bc_matrix.h5", "_raw_peak_bc_matrix.h5", "_filtered_tf_bc_matrix.h5",
    "_other.h5", "_matrix.mtx.gz", "_barcodes.tsv.gz", "_features.tsv.gz", "_atac_fragments.tsv.gz", "_x.loom", "_obj.rds", "_RAW.tar", "_gene counts.csv.gz", "_metadata.txt", "_notes.pdf",
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of series: orders of customers."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*(F.lit(s) for s in SUFFIXES))
    return o.select(
        F.concat(F.lit("GSE"), F.col("o_custkey")).alias("series_id"),
        F.col("o_orderkey").alias("pos"),
        F.concat(F.lit("GSM"), F.col("o_orderkey"), F.element_at(names, (F.col("o_orderkey") % len(SUFFIXES) + 1).cast("int"))).alias("url"),
        (F.round("o_totalprice").cast("long") * 20000).alias("size_bytes"),
    )


FILES_SQL = f"""files as (select 'GSE' || o_custkey as series_id, o_orderkey as pos, 'GSM' || o_orderkey || ([{', '.join(quoted(s) for s in SUFFIXES)}])[1 + o_orderkey % {len(SUFFIXES)}] as url,
  round(o_totalprice)::bigint * 20000 as size_bytes from orders)"""

_IMPLIED = "case " + " ".join(f"when contains(file_name, '{p}') then '{m}'" for p, m in lexicon.MATRIX_TYPES) + " else 'unknown' end"
CLASSIFIED_SQL = f"""{FILES_SQL}, named as (select *, lower(url) as file_name from files),
signals as (select *, {case_sql('file_name', lexicon.FILE_FORMATS)} as format_type, {case_sql('file_name', lexicon.FILE_MODALITIES)} as signal,
  {case_sql('file_name', lexicon.PROCESSING_LEVELS)} as processing_level,
  case {' '.join(f"when contains(file_name, '{p}') then '{p}'" for p, _ in lexicon.MATRIX_TYPES)} else '' end as matrix_type,
  {any_sql('file_name', lexicon.COUNT_MATRIX)} and not {any_sql('file_name', lexicon.NOT_COUNT_MATRIX)} as is_count_matrix from named),
classified as (select *, case when signal = 'unknown' then {_IMPLIED} else signal end as modality_signal from signals)"""
