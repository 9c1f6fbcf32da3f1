"""Incremental ingestion of landed files: each run takes what is new, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.runtime import many_small_files
from quarry.sources.soft import parse_series

#: Endings of files that Hadoop's codecs unpack.
PACKED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")


def append_new(batch: DataFrame, out: str, key: str) -> None:
    """Append the rows of a batch whose key isn't in the output yet."""
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    try:
        done = spark.read.parquet(out).select(key)
    except Exception as e:  # the first batch finds no output
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        rows = rows.join(done, key, "left_anti")
    rows.write.mode("append").parquet(out)


def ingest_series(spark: SparkSession, landed: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = parse_series, key: str = "series_id") -> None:
    """Parse all landed series texts that no earlier run has taken, then stop.

    Plain files are read as binary files, since Spark's reader of whole texts copies all of Hadoop's settings for each file, which
    takes several times as long as a small file does. Only that reader unpacks files, so packed ones are a second stream.
    """
    name = F.col("_metadata.file_name")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(landed)
    plain = files.where(~name.rlike(rf"\.({'|'.join(PACKED)})$")).select(name.alias("name"), F.col("content").cast("string").alias("text"))
    whole = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", f"*.{{{','.join(PACKED)}}}").load(landed)
    packed = whole.select(name.alias("name"), F.col("value").alias("text"))
    with many_small_files(spark):
        for files, mark in ((plain, checkpoint), (packed, f"{checkpoint}/packed")):
            texts = files.select(F.upper(F.regexp_extract("name", r"(?i)(GSE\d+)", 1)).alias("series_id"), "text")
            take = texts.writeStream.foreachBatch(lambda b, _: append_new(transform(b), out, key)).option("checkpointLocation", mark).trigger(availableNow=True)
            take.start().awaitTermination()


def event_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums per type and window of event time, with late rows bounded by a watermark; batch or stream."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")
