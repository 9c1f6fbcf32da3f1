"""Search, summaries, articles and records of the public study archive.

They are read through the data source of ``sources.archive``, as tables or as a stream of what is new, or landed as files that the
readers of sources take, so that a search can be repeated from its files. Requests go in few tasks with a delay in each, since
the archive limits requests of a second.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.acquire import Fetcher, HttpFetcher, fetch_texts
from quarry.sources import archive as source
from quarry.sources.records import ARTICLE, SUMMARY, articles_of, parsed_documents, read_search, series_hits, summaries_of
from quarry.streaming.ingest import append_new


@dataclass(frozen=True)
class Archive:
    """Addresses of the archive's services and what one request may hold."""

    # Services, database names, and identifiers in one request.
    services: str = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
    records: str = "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi"
    studies: str = "gds"
    articles: str = "pubmed"
    batch: int = 50
    fetcher: Fetcher = HttpFetcher(delay=0.4)

    def search_url(self, expression: str, limit: int, start: int) -> str:
        return f"{self.services}/esearch.fcgi?" + urlencode({"db": self.studies, "term": expression, "retmax": limit, "retstart": start, "retmode": "xml", "usehistory": "y"})


def _land(urls: DataFrame, fetcher: Fetcher, path: str) -> DataFrame:
    """Write the texts below ``path``, one a file, and return the urls that gave none, with their errors.

    A file with two documents would be read up to the end of the first one.
    """
    got = fetch_texts(urls, fetcher).withColumn("text", F.regexp_replace("text", r"\r?\n", " "))
    got.write.mode("overwrite").parquet(path + "-answers")
    kept = urls.sparkSession.read.parquet(path + "-answers")
    kept.where("error = ''").select("text").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return kept.where("error != ''").drop("text")


def land_search(spark: SparkSession, expression: str, path: str, limit: int = 20, start: int = 0, archive: Archive | None = None) -> DataFrame:
    """One search answer below ``path``: (count, ids, web_env, query_key); a search that fails is an error."""
    archive = archive or Archive()
    url = archive.search_url(expression, limit, start)
    lost = _land(spark.createDataFrame([(url,)], "url string"), archive.fetcher, path).first()
    if lost:
        raise OSError(f"search failed: {lost.error}")
    return read_search(spark, path)


def _batches(ids: DataFrame, size: int, tasks: int) -> DataFrame:
    """(ids): identifiers joined by commas, ``size`` of them at most."""
    flat = ids.select("id").distinct()
    groups = max(1, -(-flat.count() // size))
    # each of the groups by hash is cut into batches by itself
    grouped = flat.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g")).agg(F.array_sort(F.collect_list("id")).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(size))
    return grouped.select(F.explode(F.transform(starts, lambda i: F.array_join(F.slice("all", i + 1, F.lit(size)), ","))).alias("ids")).coalesce(tasks)


def land_summaries(ids: DataFrame, path: str, archive: Archive | None = None, tasks: int = 2, articles: bool = False) -> DataFrame:
    """Summaries of studies, or whole records of articles, by ``id`` in batches; returns the batches that failed."""
    archive = archive or Archive()
    service, db = ("efetch", archive.articles) if articles else ("esummary", archive.studies)
    url = F.concat(F.lit(f"{archive.services}/{service}.fcgi?db={db}&retmode=xml&id="), F.url_encode("ids"))
    return _land(_batches(ids, archive.batch, tasks).select(url.alias("url")), archive.fetcher, path)


def fetch_records(accessions: DataFrame, archive: Archive | None = None, samples: bool = False, tasks: int = 2) -> DataFrame:
    """(series_id, url, text, error): the text records of series, or of their samples."""
    archive = archive or Archive()
    what = "&targ=gsm&form=text&view=brief" if samples else "&targ=self&form=text"
    address = F.concat(F.lit(f"{archive.records}?acc="), F.url_encode("series_id"), F.lit(what))
    return fetch_texts(accessions.select("series_id", address.alias("url")).coalesce(tasks), archive.fetcher)


def open_archive(spark: SparkSession, kind: str, archive: Archive | None = None, stream: bool = False, **options: str):
    """A reader of the archive's data source for one kind of documents; ``load()`` gives (id, at, document, error)."""
    a = archive or Archive()
    source.register(spark)
    given = {"kind": kind, "services": a.services, "records": a.records, "batch": str(a.batch), "delay": str(getattr(a.fetcher, "delay", 0.0)), **options}
    return (spark.readStream if stream else spark.read).format(source.ArchiveSource.name()).options(**given)


def search_series(spark: SparkSession, expression: str, archive: Archive | None = None, **options: str) -> DataFrame:
    """Series of all hits of a search, read page by page from the archive's history."""
    found = open_archive(spark, "summaries", archive, expression=expression, **options).load()
    return series_hits(summaries_of(parsed_documents(found, SUMMARY)))


def articles_by_id(spark: SparkSession, ids: list[str], archive: Archive | None = None, **options: str) -> DataFrame:
    """Articles of a list of identifiers."""
    found = open_archive(spark, "articles", archive, ids=",".join(ids), **options).load()
    return articles_of(parsed_documents(found, ARTICLE))


def watch_series(spark: SparkSession, expression: str, out: str, checkpoint: str, archive: Archive | None = None, **options: str) -> None:
    """Append the series of the hits that no earlier run has seen to the table ``out``, then stop."""
    rows = open_archive(spark, "summaries", archive, stream=True, expression=expression, **options).load()

    def take(batch: DataFrame, _: int) -> None:
        append_new(series_hits(summaries_of(parsed_documents(batch, SUMMARY))).drop("pos"), out, "series_id")

    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
