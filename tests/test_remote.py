"""Requests against a server of this process: probing, ranges, search, summaries and records, and the commands on them."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from quarry import cli
from quarry.plans import acquire, remote

BODY = bytes(range(256)) * 40


class Site(BaseHTTPRequestHandler):
    seen: list[str] = []

    def log_message(self, *_):
        pass

    def _answer(self):
        u = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        self.seen.append(self.path)
        if u.path == "/esearch.fcgi":
            ids = range(int(q["retstart"]), int(q["retstart"]) + int(q["retmax"]))
            return 200, f"<eSearchResult><Count>120</Count><QueryKey>1</QueryKey><WebEnv>E</WebEnv><IdList>\n{''.join(f'<Id>{i}</Id>' for i in ids)}</IdList></eSearchResult>".encode()
        if u.path == "/esummary.fcgi":
            ids = q["id"].split(",")
            if len(ids) > 50:
                return 500, b""
            item = '<Item Name="{}" Type="{}">{}</Item>'
            docs = "".join("<DocSum><Id>" + i + "</Id>" + item.format("Accession", "String", "GSE" + i) + item.format("title", "String", "t" + i) + item.format("taxon", "String", "human") + item.format("n_samples", "Integer", i) + "</DocSum>\n" for i in ids)
            return 200, f"<eSummaryResult>{docs}</eSummaryResult>".encode()
        if u.path == "/acc.cgi":
            return 200, ("^SERIES = " + q["acc"] + " " + q["targ"]).encode()
        return (200, BODY) if u.path in ("/a.csv", "/whole.csv") else (404, b"")

    def do_HEAD(self):
        self._send(False)

    def do_GET(self):
        self._send(True)

    def _send(self, body):
        code, data = self._answer()
        part = self.headers.get("Range")
        if part and code == 200 and "whole" not in self.path:
            start = int(part.split("=")[1].rstrip("-"))
            code, data = (206, data[start:]) if start < len(data) else (416, b"")
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if body:
            self.wfile.write(data)


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_http_ranges_and_states(site, tmp_path):
    f = acquire.HttpFetcher(chunk=1000)
    assert f.probe(f"{site}/a.csv") == (200, len(BODY)) and f.probe(f"{site}/no") == (404, None)
    for name in ("a.csv", "whole.csv"):
        assert b"".join(f.read(f"{site}/{name}", 1500)) == BODY[1500:]
        out = tmp_path / name
        (tmp_path / f"{name}.part").write_bytes(BODY[:2222])
        assert acquire.fetch_file(f, f"{site}/{name}", str(out), wait=0) and out.read_bytes() == BODY
    assert list(f.read(f"{site}/a.csv", len(BODY))) == []
    assert not acquire.fetch_file(f, f"{site}/no", str(tmp_path / "no"), wait=0)


def test_texts_that_fail_are_rows(spark, site):
    d = spark.createDataFrame([(1, f"{site}/acc.cgi?acc=GSE1&targ=self"), (2, f"{site}/no")], "i int, url string")
    got = {r.i: (r.text, r.error) for r in acquire.fetch_texts(d, acquire.HttpFetcher(), retries=1).collect()}
    assert got[1] == ("^SERIES = GSE1 self", "") and got[2][0] is None and "404" in got[2][1]


def test_search_and_records(spark, site, tmp_path):
    from quarry.engine import Engine

    a = remote.Archive(services=site, records=f"{site}/acc.cgi", fetcher=acquire.HttpFetcher())
    Site.seen.clear()
    got = Engine(spark).find_series("lung", str(tmp_path), organism="Homo sapiens", limit=120, start=1, min_samples=20, archive=a)
    assert {r.series_id for r in got.collect()} == {f"GSE{i}" for i in range(20, 121)}
    assert parse_qs(urlparse(Site.seen[0]).query)["term"] == ['(lung) AND "Homo sapiens"[Organism]']
    first = remote.read_search(spark, f"{tmp_path}/search").first()
    assert first["count"] == 120 and len(first.ids) == 120 and (first.web_env, first.query_key) == ("E", "1")
    assert spark.read.schema("url string, error string").json(f"{tmp_path}/failed").count() == 0
    ids = spark.createDataFrame([("GSE1",), ("GSE2",)], "series_id string")
    assert {r.text for r in remote.fetch_records(ids, a, samples=True).collect()} == {"^SERIES = GSE1 gsm", "^SERIES = GSE2 gsm"}
    with pytest.raises(OSError):
        remote.land_search(spark, "x", f"{tmp_path}/none", archive=remote.Archive(services=f"{site}/no", fetcher=acquire.FolderFetcher(str(tmp_path))))


def test_commands(spark, site, tmp_path, capsys):
    def run(*words):
        assert cli.main(["--root", str(tmp_path / "root"), *words], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    def rows(name, *found):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in found))
        return str(tmp_path / name)

    files = rows("files.json", {"series_id": "GSE1", "pos": 0, "url": f"{site}/counts/a.csv"}, {"series_id": "GSE2", "pos": 0, "url": f"{site}/a.csv"})
    assert {r.get("series_id"): r["accessible_links"] for r in run("verify", files)} == {"GSE1": 0, "GSE2": 1, None: 1}
    assert {r["series_id"]: r["status"] for r in run("download", files, "--target", str(tmp_path / "got"))} == {"GSE1": "failed", "GSE2": "complete"}
    assert (tmp_path / "got" / "GSE2" / "a.csv").read_bytes() == BODY
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "counts.csv").write_text("id,a\nx,1\n")
    kinds = {"title": "tumor cancer rna", "summary": "scRNA", "organism": "Homo sapiens", "series_type": ""}
    series = rows("series.json", *({"series_id": f"GSE{i}", "supplementary_files": ["http://h/counts.csv", "http://h/x.rds"], **kinds} for i in (1, 2)))
    got = run("scan", series, "--limit", "1", "--show-files", "--save", str(tmp_path / "saved"))
    assert got[0]["series_id"] == "GSE1" and {r.get("bucket"): r.get("files") for r in got[1:]}["csv_tsv"] == 1
    assert spark.read.json(str(tmp_path / "saved")).count() == 1
    got = run("run", series, "--limit", "1", "--domain", "cancer", "--format", "csv", "--folder", str(tmp_path / "src"), "--target", str(tmp_path / "mats"))
    assert got[1]["status"] == "complete" and got[2] == {"series_id": "GSE1", "sample": "counts.csv", "count": 1}
    assert run("normalize", str(tmp_path / "mats")) == [{"series_id": "GSE1", "entries": 1}]
