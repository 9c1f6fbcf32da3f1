"""Sparse matrices as rows (cell, gene, value): reshaping, merging and quality filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_to_rows(df: DataFrame, cell: str, genes: list[str] | None = None) -> DataFrame:
    """One row per non-zero value of a table with one column per gene."""
    genes = genes or [c for c in df.columns if c != cell]
    return df.unpivot([cell], genes, "gene", "value").where("value != 0").select(F.col(cell).alias("cell"), "gene", F.col("value").cast("float").cast("double").alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("gene").alias("cell"), F.col("cell").alias("gene"), "value")


def needs_transpose(n_rows: int, n_columns: int, ratio: int = 5) -> bool:
    """Tables with far more columns than rows hold genes in rows."""
    return n_columns > ratio * n_rows


def merge_samples(samples: dict[str, DataFrame]) -> DataFrame:
    """Union of samples with a label; a gene that a sample lacks has no rows, that is, zeros."""
    return reduce(DataFrame.unionByName, (m.withColumn("sample", F.lit(s)) for s, m in samples.items()))


def quality_filter(m: DataFrame, min_genes: int = 200, min_cells: int = 3, max_mito_percent: float = 20.0, mito_prefixes: tuple[str, ...] = ("MT-", "mt-"), cell: str = "cell", gene: str = "gene", value: str = "value", within: list[str] | None = None) -> DataFrame:
    """Cells with enough genes, then genes in enough cells, then cells with few mitochondrial counts among what is left.

    Columns ``within`` keep matrices apart: each is filtered as if it were alone.
    """
    cells, genes = [*(within or []), cell], [*(within or []), gene]
    x = m.where(F.col(value) != 0)
    x = x.join(x.groupBy(*cells).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_genes).select(*cells), cells, "left_semi")
    x = x.join(x.groupBy(*genes).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_cells).select(*genes), genes, "left_semi")
    mito = F.lit(False)
    for p in mito_prefixes:
        mito = mito | F.col(gene).cast("string").startswith(p)
    share = F.try_divide(F.lit(100.0) * F.sum(F.when(mito, F.col(value)).otherwise(0.0)), F.sum(value))
    keep = x.groupBy(*cells).agg(share.alias("_share")).where(F.col("_share") < max_mito_percent).select(*cells)
    return x.join(keep, cells, "left_semi")
