"""The study archive as a data source: ``spark.read.format("study_archive")`` and ``spark.readStream``.

Rows are (id, at, document, error): one XML document, or one text record, for each id. Options: ``kind`` (summaries,
articles, series or samples), ``services`` and ``records`` (addresses), ``ids`` (joined by commas) or ``expression`` (a search),
``batch`` (ids of one request), ``tasks`` (partitions at most, 0 for one a request), ``delay`` (seconds before each request of a
partition), ``retries``, ``wait`` and ``timeout``.

A filter ``id = ...`` or ``id in (...)`` is pushed down: only those ids are asked for. A search is asked once, for its size and its
history keys; its pages are then read from the archive's history by these keys, a page a request, so no list of ids passes
through the driver. A request that fails gives rows with its error.

As a stream, the source gives the hits of a search that are new. The archive lists the newest first, so a hit's place is
counted from the oldest (``at``), and an offset holds how many hits were there and the history keys under which they were seen: a batch
that is run again asks the same history. Where that has expired the search is asked anew; places from the oldest stay as they are.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quarry.plans.acquire import HttpFetcher

SCHEMA = "id string, at long, document string, error string"

# Database, service, document element and path of its identifier, by kind.
SERVICES = {"summaries": ("gds", "esummary", "DocSum", "Id"), "articles": ("pubmed", "efetch", "PubmedArticle", "MedlineCitation/PMID")}
# What a record's request asks for, by kind.
RECORDS = {"series": {"targ": "self", "form": "text"}, "samples": {"targ": "gsm", "form": "text", "view": "brief"}}


@dataclass(frozen=True)
class Request:
    """One request: of these ids, or of a page of a history whose first document has the place ``at``, counting down."""

    ids: tuple[str, ...] = ()
    web_env: str = ""
    query_key: str = ""
    start: int = 0
    length: int = 0
    at: int = 0


class Requests(InputPartition):
    def __init__(self, value: list[Request]):
        self.value = value


class Client:
    """Requests of one kind by the source's options."""

    def __init__(self, options: dict[str, str]):
        self.kind = options.get("kind", "summaries")
        if self.kind not in SERVICES and self.kind not in RECORDS:
            raise ValueError(f"kind is one of {', '.join([*SERVICES, *RECORDS])}, not {self.kind!r}")
        self.services, self.records = options.get("services", "").rstrip("/"), options.get("records", "")
        self.batch = max(1, int(options.get("batch", "50"))) if self.kind in SERVICES else 1
        self.tasks = int(options.get("tasks", "2"))
        self.retries, self.wait = max(1, int(options.get("retries", "3"))), float(options.get("wait", "5"))
        self.fetcher = HttpFetcher(timeout=float(options.get("timeout", "30")), delay=float(options.get("delay", "0.4")))
        self.expression = options.get("expression", "")
        self.ids = tuple(x.strip() for x in options.get("ids", "").split(",") if x.strip())

    def get(self, url: str) -> str:
        for attempt in range(1, self.retries + 1):
            try:
                return b"".join(self.fetcher.read(url, 0)).decode("utf-8", "replace")
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * attempt)
        raise AssertionError

    def search(self) -> tuple[int, str, str]:
        """Number of hits and history keys."""
        db = SERVICES[self.kind][0]
        root = ET.fromstring(self.get(f"{self.services}/esearch.fcgi?" + urlencode({"db": db, "term": self.expression, "retmax": 0, "retstart": 0, "retmode": "xml", "usehistory": "y"})))
        text = lambda path: (root.findtext(path) or "").strip()
        return int(text("Count") or 0), text("WebEnv"), text("QueryKey")

    def url(self, r: Request) -> str:
        if self.kind in RECORDS:
            return f"{self.records}?" + urlencode({"acc": r.ids[0], **RECORDS[self.kind]})
        db, service, _, _ = SERVICES[self.kind]
        what = {"id": ",".join(r.ids)} if r.ids else {"WebEnv": r.web_env, "query_key": r.query_key, "retstart": r.start, "retmax": r.length}
        return f"{self.services}/{service}.fcgi?" + urlencode({"db": db, "retmode": "xml", **what})

    def documents(self, r: Request) -> list[tuple[str, str]]:
        """(id, document) in the archive's order."""
        text = self.get(self.url(r))
        if self.kind in RECORDS:
            return [(r.ids[0], text)]
        _, _, element, path = SERVICES[self.kind]
        return [((d.findtext(path) or "").strip(), ET.tostring(d, encoding="unicode").strip()) for d in ET.fromstring(text).iter(element)]

    def rows(self, r: Request) -> Iterator[tuple]:
        try:
            found = self.documents(r)
        except (OSError, ET.ParseError) as e:
            for i in r.ids or (None,):
                yield i, None, None, f"{type(e).__name__}: {e}"
            return
        if not r.ids:
            for n, (i, text) in enumerate(found):
                yield i, r.at - n, text, ""
            return
        given = dict(reversed(found))
        for i in r.ids:
            yield i, None, given.get(i), "" if i in given else "no document"

    def dealt(self, requests: list[Request]) -> list[Requests]:
        """Requests over partitions, neighbours apart."""
        n = min(len(requests), self.tasks) if self.tasks > 0 else len(requests)
        return [Requests(requests[i::n]) for i in range(n)] or [Requests([])]

    def pages(self, count: int, web_env: str, query_key: str, first: int = 0) -> list[Request]:
        """Pages of the history whose hits have places ``first`` and more, counted from the oldest of ``count``."""
        newest = count - first
        return [Request((), web_env, query_key, s, min(self.batch, newest - s), count - 1 - s) for s in range(0, newest, self.batch)]


class ArchiveReader(DataSourceReader):
    def __init__(self, client: Client):
        self.client = client
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",):
                ids = {f.value}
            elif isinstance(f, In) and f.attribute == ("id",):
                ids = set(f.value)
            else:
                yield f
                continue
            ids = {i for i in ids if i is not None}
            self.wanted = ids if self.wanted is None else self.wanted & ids

    def partitions(self) -> Sequence[InputPartition]:
        c = self.client
        if c.ids or not c.expression:
            if not c.ids and self.wanted is None:
                raise ValueError("the archive needs ids, an expression or a filter on id")
            ids = sorted(set(c.ids) if self.wanted is None else self.wanted & set(c.ids) if c.ids else self.wanted)
            return c.dealt([Request(tuple(ids[i : i + c.batch])) for i in range(0, len(ids), c.batch)])
        if c.kind in RECORDS:
            raise ValueError("records are asked for by ids")
        return c.dealt(c.pages(*c.search()))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in partition.value:
            for row in self.client.rows(r):
                if r.ids or self.wanted is None or row[0] in self.wanted:
                    yield row


class ArchiveStream(DataSourceStreamReader):
    def __init__(self, client: Client):
        if not client.expression or client.kind in RECORDS:
            raise ValueError("a stream needs an expression, and summaries or articles")
        self.client = client
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {"seen": 0, "web_env": "", "query_key": ""}

    def latestOffset(self) -> dict:
        count, web_env, query_key = self.client.search()
        if count != self.last.get("seen"):  # keys alone are no news
            self.last = {"seen": count, "web_env": web_env, "query_key": query_key}
        return self.last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        c = self.client
        return c.dealt(c.pages(end["seen"], end["web_env"], end["query_key"], min(start["seen"], end["seen"])))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in partition.value:
            rows = list(self.client.rows(r))
            if not rows or rows[0][3]:  # the history has expired, or a request was lost
                count, web_env, query_key = self.client.search()
                rows = list(self.client.rows(Request((), web_env, query_key, count - 1 - r.at, r.length, r.at)))
                if not rows or rows[0][3]:
                    raise OSError(f"no documents from place {r.at}: {rows[0][3] if rows else 'an empty page'}")
            yield from rows


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(Client(self.options))

    def streamReader(self, schema: StructType) -> ArchiveStream:
        return ArchiveStream(Client(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
