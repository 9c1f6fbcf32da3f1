"""Datasets from their files: flags, filters, download choice and existing copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import lexicon
from quarry.functions.text import joined
from quarry.operators.rules import download_bucket, organism_name


def dataset_flags(files: DataFrame, series: str = "series_id", probed: str | None = None) -> DataFrame:
    """One row per series: format flags, modalities, convertible, formats as text.

    ``files`` has been through ``classify_files``. ``probed`` names a boolean column of rows that came from probing
    samples; for those any part of a matrix triplet is enough, for the others the matrix and one more part are.
    """
    own = F.lit(True) if probed is None else ~F.col(probed)
    extra = F.lit(False) if probed is None else F.col(probed)
    f, m = F.col("format_type"), F.col("matrix_type")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    generic = own & (f == "h5_generic")
    parts = ("mtx_matrix", "mtx_barcodes", "mtx_features")
    n_parts = sum((has(own & (f == p)).cast("int") for p in parts[1:]), has(own & (f == parts[0])).cast("int"))
    flags = {
        "has_h5_10x_filtered_feature": has((f == "h5_10x_filtered_feature") | (generic & (m == "filtered_feature_bc_matrix"))),
        "has_h5_10x_raw_feature": has(f == "h5_10x_raw_feature"),
        "has_h5_10x_filtered_peak": has((f == "h5_10x_filtered_peak") | (generic & (m == "filtered_peak_bc_matrix"))),
        "has_h5_10x_raw_peak": has(f == "h5_10x_raw_peak"),
        "has_h5ad": has(f == "h5ad"),
        "has_mtx_triplet": (has(own & (f == "mtx_matrix")) & (n_parts >= 2)) | has(extra & f.isin(*parts)),
        "has_loom": has(f == "loom"),
        "has_csv_tsv": has(f.isin("csv", "tsv")),
        "has_fragments": has(f == "fragments"),
        "has_tar": has(own & (f == "tar")),
        "has_rds": has(f == "rds"),
    }
    seen = F.collect_set(F.when(own & (F.col("modality_signal") != "unknown"), F.col("modality_signal")))
    later = F.collect_set(F.when(extra & (F.col("modality_signal") != "unknown"), F.col("modality_signal")))
    strong = [x for x in lexicon.CONVERTIBLE if x not in ("csv", "tsv")]
    convertible = has(f.isin(*strong) | (f.isin("csv", "tsv") & F.col("is_count_matrix")))
    out = files.groupBy(series).agg(*(c.alias(k) for k, c in flags.items()), seen.alias("_seen"), later.alias("_later"), convertible.alias("is_convertible"), F.count("*").alias("n_files"))
    guess = F.filter(F.array(F.when(F.col("has_h5_10x_filtered_feature") | F.col("has_h5_10x_raw_feature"), "rna"), F.when(F.col("has_h5_10x_filtered_peak") | F.col("has_h5_10x_raw_peak") | F.col("has_fragments"), "atac")), lambda x: x.isNotNull())
    known = F.when(F.size("_seen") == 0, guess).otherwise(F.col("_seen"))
    both = F.array_contains(known, "rna") & F.array_contains(known, "atac")
    known = F.when(both, F.array_union(known, F.array(F.lit("multiome")))).otherwise(known)
    out = out.withColumn("modalities", F.array_sort(F.array_union(known, F.col("_later")))).drop("_seen", "_later")
    return out.withColumn("available_formats", joined(F.filter(F.array(*(F.when(F.col(c), n) for c, n in lexicon.FORMAT_NAMES)), lambda x: x.isNotNull()), "none"))


def modalities_text(modalities: Column) -> Column:
    return joined(F.array_sort(modalities), "unknown")


def format_predicate(names: list[str]) -> Column | None:
    """Files that any of the named format filters accepts; no filter accepts all, an unknown name accepts none."""
    if not names:
        return None
    accepted, flag = set(), False
    for n in (x.lower().strip() for x in names):
        if n in lexicon.FORMAT_FILTERS:
            types = lexicon.FORMAT_FILTERS[n]
            flag, accepted = flag or types is None, accepted | set(types or ())
    hit = F.col("format_type").isin(*sorted(accepted)) if accepted else F.lit(False)
    return hit | F.col("is_count_matrix") if flag else hit


def filter_files(files: DataFrame, formats: list[str] | None = None, modality: str | None = None) -> DataFrame:
    keep = format_predicate(formats or [])
    out = files if keep is None else files.where(keep)
    return out if not modality or modality == "any" else out.where(F.col("modality_signal").isin(modality, "unknown"))


def apply_filters(series: DataFrame, files: DataFrame, key: str = "series_id", domain: str | None = None, modality: str | None = None, formats: list[str] | None = None, organism: str | None = None, require_format: bool = False, require_convertible: bool = False) -> tuple[DataFrame, DataFrame]:
    """(series, their files) after the chain of dataset filters and the file filter.

    ``series``: key, domain, modalities, organism, is_convertible.
    """
    out = series.where("is_convertible") if require_convertible else series
    if domain:
        out = out.where(F.col("domain") == domain.lower())
    if modality:
        has = lambda m: F.array_contains("modalities", m)
        wanted = has("multiome") | (has("rna") & has("atac")) if modality.lower() == "multiome" else has(modality.lower())
        out = out.where(wanted)
    if organism:
        out = out.where(F.lower("organism").contains(F.lower(organism_name(F.lit(organism.lower()), 4))))
    kept = filter_files(files, formats)
    if formats and require_format:
        out = out.join(kept.select(key).distinct(), key, "left_semi")
    return out, kept.join(out.select(key), key, "left_semi")


def download_order(files: DataFrame, series: str = "series_id", name: str = "url", pos: str = "pos", size: str | None = None, max_gb: float = 5.0) -> DataFrame:
    """Files to download in order of priority; ``other`` files only where a series has nothing else; too large ones leave."""
    order = ("h5ad", "h5", "mtx", "tar", "csv_tsv", "loom", "other")
    prio = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("bucket"))
    x = files.withColumn("bucket", download_bucket(F.col(name))).withColumn("priority", prio.cast("int"))
    known = F.bool_or(F.col("bucket") != "other").over(Window.partitionBy(series))
    x = x.withColumn("_known", known).where((F.col("bucket") != "other") | ~F.col("_known")).drop("_known")
    if size:
        x = x.where(F.col(size).isNull() | (F.col(size) <= max_gb * 1024**3))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(series).orderBy("priority", pos)))


def not_elsewhere(targets: DataFrame, existing: DataFrame, key: str = "series_id") -> DataFrame:
    """Targets (key, path) of series that stand in no other place; places above, below or equal don't count."""
    e = existing.select(F.upper(key).alias("_key"), F.col("path").alias("_path"))
    other = (F.upper(F.col(key)) == F.col("_key")) & (F.col("_path") != F.col("path")) & ~F.col("_path").startswith(F.concat("path", F.lit("/"))) & ~F.col("path").startswith(F.concat("_path", F.lit("/")))
    return targets.join(e, other, "left_anti")


def best_output(paths: DataFrame, path: str = "path", pos: str = "pos") -> DataFrame:
    """One matrix file per series: SERIES.h5ad, else SERIES_merged.h5ad, else the first."""
    base = F.substring_index(path, "/", -1)
    series = F.upper(F.regexp_extract(base, r"(?i)^(GSE\d+)", 1))
    x = paths.withColumn("series_id", series).where("series_id != ''")
    prio = F.when(F.lower(base) == F.concat(F.lower("series_id"), F.lit(".h5ad")), 0).when(F.lower(base) == F.concat(F.lower("series_id"), F.lit("_merged.h5ad")), 1).otherwise(2)
    return x.groupBy("series_id").agg(F.min_by(path, F.struct(prio.alias("prio"), F.col(pos).alias("pos"))).alias("path"))


def matrix_triplets(files: DataFrame, folder: str = "folder", name: str = "name", every: bool = False) -> DataFrame:
    """The matrix, barcodes and features files of each folder that share the most name tokens, or those of each matrix.

    Folders hold few files; candidates are matched inside a folder only.
    """
    n = F.lower(name)
    kind = F.when(n.contains("matrix.mtx"), "m").when(n.contains("barcodes.tsv"), "b").when(n.contains("features.tsv") | n.contains("genes.tsv"), "f")
    stem = F.regexp_replace(n, r"(matrix\.mtx|(barcodes|features|genes)\.tsv)(\.gz)?$", "")
    x = files.select(folder, name, kind.alias("kind"), F.array_distinct(F.filter(F.split(stem, r"[_\-.]+"), lambda t: t != "")).alias("tokens")).where("kind is not null")
    one = lambda k, c: x.where(F.col("kind") == k).select(folder, F.col(name).alias(c), F.col("tokens").alias(f"{c}_tokens"))
    pairs = lambda k, c: one("m", "matrix").join(one(k, c), folder).withColumn("score", F.size(F.array_intersect("matrix_tokens", f"{c}_tokens"))).groupBy(folder, "matrix").agg(F.min_by(F.struct(c, "score"), F.struct((-F.col("score")).alias("s"), F.col(c).alias("c"))).alias("x")).select(folder, "matrix", f"x.{c}", F.col("x.score").alias(f"{c}_score"))
    both = pairs("b", "barcodes").join(pairs("f", "features"), [folder, "matrix"])
    both = both.withColumn("score", F.col("barcodes_score") + F.col("features_score"))
    if every:
        return both.select(folder, "matrix", "barcodes", "features", "score")
    return both.groupBy(folder).agg(F.min_by(F.struct("matrix", "barcodes", "features", "score"), F.struct((-F.col("score")).alias("s"), F.col("matrix").alias("m"))).alias("x")).select(folder, "x.*")


def bucket_histogram(files: DataFrame, series: str = "series_id", name: str = "url") -> DataFrame:
    """(series, bucket, files): how many files of each download category a series has."""
    return files.groupBy(series, download_bucket(F.col(name)).alias("bucket")).agg(F.count("*").alias("files"))


def copies_needed(chosen: DataFrame, present: DataFrame, key: str = "series_id") -> DataFrame:
    """Chosen matrix files (key, path, size_bytes) that their series folder lacks or has in another size.

    ``present``: key, size_bytes of the canonical files that stand already.
    """
    there = present.groupBy(key).agg(F.max("size_bytes").alias("_there"))
    out = chosen.join(there, key, "left").where(F.col("_there").isNull() | (F.col("_there") != F.col("size_bytes"))).drop("_there")
    return out.withColumn("target", F.concat(key, F.lit("/"), key, F.lit(".h5ad")))


def downloadable(files: DataFrame) -> DataFrame:
    """Classified files that are worth fetching: count matrices of any format, and all others but serialized R objects."""
    return files.where(F.col("is_count_matrix") | (F.col("format_type") != "rds"))


def selected(rows: DataFrame, wanted: DataFrame, key: str = "series_id") -> DataFrame:
    """Rows of the wanted accessions."""
    return rows.join(wanted.select(key), key, "left_semi")


def uncovered(panel: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """Members of a panel that nothing covers; a covered name of null covers none."""
    return panel.join(covered.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def filled(row: str, *others: str) -> Column:
    """A column's own text, else the first of the others that isn't null, else empty."""
    return F.coalesce(F.when(F.col(row) != "", F.col(row)), *(F.col(o) for o in others), F.lit(""))
