"""Matrix files: triplets, separated tables, folder scans and a registry of readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.ranking import make_unique
from quarry.operators.rules import converter_format
from quarry.runtime import Workspace

# Files of the pipeline itself, and tables that hold no expression values.
OWN_FILES = ("dataset_meta.json", "download_manifest_standard.tsv", "download_manifest.csv", "download_manifest.json", "conversion_summary.json")
OTHER_TABLES = ("fragments.tsv", "positions_file.csv")


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, name, length, format) of data files below a folder; contents aren't read, and files of no bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("mtime"))
    x = files.withColumn("name", F.substring_index("path", "/", -1)).withColumn("folder", F.expr("substring(path, 1, length(path) - length(name) - 1)"))
    low = F.lower("name")
    keep = ~low.isin(*OWN_FILES)
    for t in OTHER_TABLES:
        keep = keep & ~low.contains(t)
    return x.where(keep).withColumn("format", converter_format(F.col("path")))


def series_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """(series_id, paths) of the folders whose name holds a series accession."""
    base = F.substring_index(path, "/", -1)
    x = paths.select(F.upper(F.regexp_extract(base, r"(?i)(GSE\d+)", 1)).alias("series_id"), F.col(path).alias("path")).where("series_id != ''")
    return x.groupBy("series_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def newest(listing: DataFrame, group: str) -> DataFrame:
    return listing.groupBy(group).agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def scan_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, block, at, value): lines of files below a folder; (block, at) orders the lines of one file."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    # the scan names files as URLs: three slashes, and escapes
    url = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return text.select(F.regexp_replace(url, "^file:/+", "file:/").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered_lines(lines: DataFrame, out: str = "n") -> DataFrame:
    """``lines`` (path, block, at, ...) with each line's number in its file, from 0; no task sees more than one split of a file.

    Lines of a split follow each other, so a line's number is its place in its split and the lines of the splits before. Those are
    sums over one row a split. ``lines`` are to be a saved table, since ``at`` may differ between two scans.
    """
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("_first"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["path", "block"]).withColumn(out, F.col("at") + F.col("_shift")).drop("_shift")


def _separator(line: Column) -> Column:
    return F.when(line.contains("\t"), "\t").when(line.contains(";"), ";").otherwise(",")


def _fields(line: Column, sep: Column) -> Column:
    """Fields of a line. Quoted ones may hold separators and doubled quotes, but no line ends."""
    quoted = F.lit(None).cast("string")
    for s in ("\t", ";", ","):
        quoted = F.when(sep == s, F.lit(f'{s}("[^"]*+(?:""[^"]*+)*+"|[^{s}]*)')).otherwise(quoted)
    some = F.regexp_extract_all(F.concat(sep, line), quoted, 1)
    bare = F.transform(some, lambda x: F.replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))
    return F.when(line.contains('"'), bare).otherwise(F.split(line, sep, -1))


def table_entries(lines: DataFrame, ratio: int = 5) -> DataFrame:
    """(source, cell, gene, value) of the lines (path, block, at, value) of separated tables with an index column.

    Tables with over ``ratio`` times as many columns as rows hold genes in rows. A header may lack the corner. Fields that
    are no numbers, and zeros, give no entry; of equal names each one's entries stay.
    """
    rows = lines.where(F.trim("value") != "")
    first = rows.groupBy("path").agg(F.min(F.struct("block", "at", "value")).alias("h"), (F.count("*") - 1).alias("n"))
    sep = _separator(F.col("h.value"))
    heads = first.select("path", "n", F.col("h.block").alias("hb"), F.col("h.value").alias("hv"), sep.alias("sep"), _fields(F.col("h.value"), sep).alias("head"))
    # the header's own line is told by its text: a second one like it holds no numbers, or the same names once more
    x = rows.join(heads, "path").where("not (block = hb and value = hv)").withColumn("f", _fields(F.col("value"), F.col("sep")))
    names = F.when(F.size("head") < F.size("f"), F.col("head")).otherwise(F.slice("head", 2, F.size("head")))
    x = x.select("path", F.col("f")[0].alias("row"), names.alias("names"), "n", F.posexplode(F.slice("f", 2, F.size("f"))).alias("pos", "v"))
    x = x.select("path", "row", F.get("names", F.col("pos")).alias("column"), F.trim("v").try_cast("float").cast("double").alias("value"), (F.size("names") > ratio * F.col("n")).alias("flip"))
    x = x.where("value != 0 and column is not null")
    return x.select(F.col("path").alias("source"), F.when(F.col("flip"), F.col("column")).otherwise(F.col("row")).alias("cell"), F.when(F.col("flip"), F.col("row")).otherwise(F.col("column")).alias("gene"), "value")


def triplet_entries(triplets: DataFrame, lines: DataFrame) -> DataFrame:
    """(source, cell, gene, value) of triplets (matrix, barcodes, features: paths) whose lines are given.

    Rows of a matrix are features. Names come from the second column of a features file, else the first, and are made unique.
    Lines of axis files are numbered by splits, so the axes of a large file are dealt over tasks like its entries.
    """
    ws = Workspace(lines.sparkSession, "axes")
    m = lines.join(triplets.select(F.col("matrix").alias("path")), "path", "left_semi").where("not startswith(value, '%') and trim(value) != ''")
    size = m.groupBy("path").agg(F.min(F.struct("block", "at")).alias("h"))
    v = F.split(F.trim("value"), r"\s+")
    entries = m.join(size, "path").where("struct(block, at) != h").select(F.col("path").alias("source"), v.alias("v")).where(F.size("v") >= 2)
    entries = entries.select("source", (F.col("v")[0].try_cast("long") - 1).alias("r"), (F.col("v")[1].try_cast("long") - 1).alias("c"), F.coalesce(F.get("v", F.lit(2)).try_cast("double"), F.when(F.size("v") == 2, 1.0)).alias("value"))

    def axis(kind: str, idx: str, name: str) -> DataFrame:
        own = ws.save(lines.join(triplets.select(F.col(kind).alias("path")).distinct(), "path", "left_semi"), kind)
        x = numbered_lines(own, idx).join(triplets.select(F.col(kind).alias("path"), F.col("matrix").alias("source")), "path")
        parts = F.split("value", "\t")
        second = F.get(parts, F.lit(1))
        one = F.when(second != "", second) if kind == "features" else F.lit(None)
        named = x.select("source", idx, F.coalesce(one, parts[0]).alias("name"))
        return make_unique(named, "name", idx, group=["source"]).select("source", idx, F.col("unique_name").alias(name))

    out = entries.where("value != 0").join(axis("barcodes", "c", "cell"), ["source", "c"]).join(axis("features", "r", "gene"), ["source", "r"])
    return out.select("source", "cell", "gene", "value")


def read_triplet(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """(cell, gene, value) of a matrix file whose rows are features; names are made unique."""
    parts = (matrix, barcodes, features)
    lines = [scan_lines(spark, p).withColumn("path", F.lit(p)) for p in parts]
    one = spark.range(1).select(*(F.lit(p).alias(c) for p, c in zip(parts, ("matrix", "barcodes", "features"), strict=True)))
    return triplet_entries(one, lines[0].unionByName(lines[1]).unionByName(lines[2])).drop("source")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(cell, gene, value) of a separated table with an index column; wide tables have genes in rows."""
    return table_entries(scan_lines(spark, path)).drop("source")


def _hdf5(kind: str) -> Callable:
    def read(spark: SparkSession, path: str) -> DataFrame:
        from quarry.plans.convert import reachable
        from quarry.sources.hdf5 import read_hdf5

        one = spark.createDataFrame([(path, kind)], "path string, format string")
        # a single file's error is the reader's error
        rows = read_hdf5(one, reachable)
        return rows.select("cell", "gene", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("double")).otherwise(F.col("value")).alias("value"))

    return read


#: Reader of each format; all take (spark, path).
READERS: dict[str, Callable] = {"csv": read_table, "tsv": read_table} | {k: _hdf5(k) for k in ("h5ad", "h5_10x", "h5_other", "loom")}


def read_any(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(cell, gene, value) of one file of a known format."""
    if kind not in READERS:
        raise ValueError(f"no reader for {kind!r}")
    return READERS[kind](spark, path)
