"""The archive's data source against a server of this process: batches, pushed filters, history pages and the stream's restarts."""

from __future__ import annotations

import threading
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quarry.config import load_config
from quarry.engine import Engine
from quarry.plans import remote
from quarry.plans.acquire import HttpFetcher


class Site(BaseHTTPRequestHandler):
    """Studies 1 to ``count``, newest first; searches leave histories, which can be forgotten."""

    count = 0
    searches = 0
    broken: set[str] = set()
    histories: dict[str, int] = {}
    seen: list[tuple[str, dict]] = []

    def log_message(self, *_):
        pass

    def do_GET(self):
        u = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        self.seen.append((u.path, q))
        code, body = self._answer(u.path, q)
        self.send_response(code)
        self.send_header("Content-Length", str(len(body.encode())))
        self.end_headers()
        self.wfile.write(body.encode())

    def _answer(self, path, q):
        c = type(self)
        if path == "/esearch.fcgi":
            c.searches += 1
            env = f"E{c.searches}"
            c.histories[env] = c.count
            return 200, f"<eSearchResult><Count>{c.count}</Count><QueryKey>1</QueryKey><WebEnv>{env}</WebEnv></eSearchResult>"
        if path == "/acc.cgi":
            return (404, "") if q["acc"] in c.broken else (200, f"^SERIES = {q['acc']}\n!Series_title = {q['targ']} of {q['acc']}\n")
        if "id" in q:
            ids = [i for i in q["id"].split(",") if i.isdigit() and int(i) <= c.count]
            if c.broken & set(ids):
                return 500, ""
        elif q["WebEnv"] in c.histories:
            n, start = c.histories[q["WebEnv"]], int(q["retstart"])
            ids = list(map(str, range(n, 0, -1)))[start : start + int(q["retmax"])]
        else:
            return 200, "<eSummaryResult><ERROR>expired</ERROR></eSummaryResult>"
        if path == "/efetch.fcgi":
            docs = "".join(f'<PubmedArticle><MedlineCitation><PMID Version="1">{i}</PMID><Article><ArticleTitle>a{i}</ArticleTitle></Article></MedlineCitation></PubmedArticle>' for i in ids)
            return 200, f"<PubmedArticleSet>{docs}</PubmedArticleSet>"
        item = '<Item Name="{}" Type="{}">{}</Item>'.format
        docs = "".join(f"<DocSum><Id>{i}</Id>{item('Accession', 'String', 'GSE' + str(int(i) % 200))}{item('title', 'String', 't' + i)}{item('n_samples', 'Integer', i)}</DocSum>" for i in ids)
        return 200, f"<eSummaryResult>{docs}</eSummaryResult>"


@pytest.fixture()
def archive():
    Site.count, Site.searches, Site.broken, Site.histories, Site.seen = 120, 0, set(), {}, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_address[1]}"
    yield remote.Archive(services=site, records=f"{site}/acc.cgi", fetcher=HttpFetcher())
    server.shutdown()


def asked(path):
    return [q for p, q in Site.seen if p == path]


def test_ids_go_in_batches_and_failures_are_rows(spark, archive):
    ids = ",".join(map(str, [*range(1, 121), 999]))
    Site.broken = {"7"}
    got = remote.open_archive(spark, "summaries", archive, ids=ids, retries="1").load()
    assert got.rdd.getNumPartitions() == 2
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 121 and len(asked("/esummary.fcgi")) == 3 and max(len(q["id"].split(",")) for q in asked("/esummary.fcgi")) == 50
    lost = {i for i, r in rows.items() if r.error}
    batch = next(set(q["id"].split(",")) for q in asked("/esummary.fcgi") if "7" in q["id"].split(","))
    assert lost == batch | {"999"} and all(rows[i].document is None for i in lost) and "HTTPError" in rows["7"].error and rows["120"].document.startswith("<DocSum>")
    assert remote.open_archive(spark, "summaries", archive, ids=ids, tasks="0").load().rdd.getNumPartitions() == 3


def test_filters_on_ids_are_pushed_down(spark, archive):
    read = remote.open_archive(spark, "summaries", archive)
    assert {r.id for r in read.load().where("id in ('5', '8')").collect()} == {"5", "8"}
    assert [q["id"] for q in asked("/esummary.fcgi")] == ["5,8"]
    Site.seen.clear()
    some = remote.open_archive(spark, "summaries", archive, ids="3,4,5").load()
    assert [r.id for r in some.where((F.col("id") == "4") & (F.col("error") == "")).collect()] == ["4"] and [q["id"] for q in asked("/esummary.fcgi")] == ["4"]
    assert some.where("id = '77'").collect() == []
    with pytest.raises(Exception, match="ids, an expression or a filter"):
        read.load().collect()


def test_searches_are_read_through_their_history(spark, archive):
    got = remote.search_series(spark, "lung", archive).collect()
    assert {r.series_id for r in got} == {f"GSE{i}" for i in range(1, 121)} and {r.title for r in got} == {f"t{i}" for i in range(1, 121)}
    assert len(asked("/esearch.fcgi")) == 1 and asked("/esearch.fcgi")[0]["term"] == "lung"
    assert sorted((int(q["retstart"]), int(q["retmax"])) for q in asked("/esummary.fcgi")) == [(0, 50), (50, 50), (100, 20)] and {q["WebEnv"] for q in asked("/esummary.fcgi")} == {"E1"}
    Site.count = 210  # 201 to 210 are newer hits of series 1 to 10
    titles = {r.series_id: r.title for r in remote.search_series(spark, "lung", archive).collect()}
    assert titles["GSE5"] == "t205" and titles["GSE11"] == "t11"
    Site.count = 0
    assert remote.search_series(spark, "lung", archive).collect() == []


def test_articles_and_records(spark, archive):
    assert {(r.pmid, r.title) for r in remote.articles_by_id(spark, ["3", "4", "500"], archive).collect()} == {("3", "a3"), ("4", "a4")}
    rows = remote.open_archive(spark, "samples", archive, ids="GSE1,GSE2").load().collect()
    assert {r.document.splitlines()[1] for r in rows} == {"!Series_title = gsm of GSE1", "!Series_title = gsm of GSE2"}
    with pytest.raises(Exception, match="kind is one of"):
        remote.open_archive(spark, "nothing", archive, ids="1").load().collect()


def test_a_restarted_stream_reads_only_what_is_new(spark, archive, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    watch = lambda: remote.watch_series(spark, "lung", out, check, archive, retries="1")
    watch()
    assert spark.read.parquet(out).count() == 120
    for more in (0, 7):
        Site.seen.clear()
        Site.count += more
        watch()
        pages = asked("/esummary.fcgi")
        assert [(int(q["retstart"]), int(q["retmax"])) for q in pages] == ([(0, 7)] if more else [])
        assert spark.read.parquet(out).count() == Site.count


def test_a_batch_that_is_run_again_asks_the_same_history(spark, archive, tmp_path):
    from quarry.sources.archive import ArchiveStream, Client

    options = {"services": archive.services, "expression": "lung", "delay": "0", "retries": "1", "batch": "40"}
    first = ArchiveStream(Client(options))
    end = first.latestOffset()
    assert first.latestOffset() == end  # a new history alone is no news
    read = lambda s, a, b: [row for p in s.partitions(a, b) for row in s.read(p)]
    start = {"seen": 100, "web_env": "", "query_key": ""}
    Site.count = 125
    again = ArchiveStream(Client(options))
    assert [r[:2] for r in read(again, start, end)] == [(str(i), i - 1) for i in range(120, 100, -1)]
    Site.histories.clear()  # expired: places from the oldest are the same in a new history
    assert sorted(r[1] for r in read(again, start, end)) == list(range(100, 120)) and {r[0] for r in read(again, start, end)} == {str(i) for i in range(101, 121)}
    assert read(again, end, end) == []


def test_lookup_and_watch_of_the_engine(spark, archive, tmp_path):
    e = Engine(spark, replace(load_config(env={}), root=str(tmp_path)))
    Site.broken = {"GSE2"}
    archive = replace(archive, fetcher=HttpFetcher(timeout=5))
    series, lost = e.lookup(spark.createDataFrame([(" gse1 ",), ("GSE2",), ("x",)], "id string"), archive)
    assert [(r.series_id, r.title) for r in series.collect()] == [("GSE1", "self of GSE1")]
    assert [r.series_id for r in lost.collect()] == ["GSE2"]
    assert e.watch("lung", archive).count() == 120
