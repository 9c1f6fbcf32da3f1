"""Registered models in one plan, answers as streams of JSON lines, and downloads in ranges."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry.plans import acquire
from quarry.plans.answer import envelope
from quarry.plans.retrieve import RetrievalSpec, retrieve
from quarry.providers import HttpGenerator, ModelRegistry, ModelSpec, Providers, TokenStream, ndjson


def lengths(device):
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def vowels(device):
    if device != "cpu":
        raise RuntimeError("no memory")
    return lambda texts: [[float(sum(c in "aeiou" for c in t)), 0.0, 2.0] for t in texts]


def overlap(device):
    return lambda pairs: [len(set(q.split()) & set(p.split())) for q, p in pairs]


REGISTRY = ModelRegistry(
    [
        ModelSpec("len", "encoder", lengths, query_prefix="q:", document_prefix="doc:", unit=False, batch=2),
        ModelSpec("vow", "encoder", vowels, device="cuda"),
        ModelSpec("cross", "reranker", overlap),
        ModelSpec("minus", "reranker", lambda device: lambda pairs: [-len(p) for _, p in pairs]),
    ]
)


def test_models_switch_by_key_in_one_plan(spark):
    rows = [(i, "aei xyz"[: i % 8], "len" if i % 3 else "vow") for i in range(40)] + [(99, None, "len")]
    got = {r.i: r.vec for r in REGISTRY.vectors(spark.createDataFrame(rows, "i int, text string, model string").repartition(3), "text").collect()}
    for i, t, m in rows:
        n = sum(c in "aeiou" for c in t or "")
        want = [len("doc:" + (t or "")), 1.0] if m == "len" else [n / (n * n + 4) ** 0.5, 0.0, 2 / (n * n + 4) ** 0.5]
        assert got[i] == pytest.approx(want, abs=1e-6)
    assert REGISTRY.encode("ab", "len") == [4.0, 1.0] and REGISTRY.encode("ab", "len", as_query=False) == [6.0, 1.0]
    pairs = spark.createDataFrame([("a b", "b c", "cross"), ("a b", "b c", "minus"), (None, None, "cross")], "q string, p string, model string")
    assert sorted(r.rerank_score for r in REGISTRY.scores(pairs, "q", "p").collect()) == [-3.0, 0.0, 1.0]
    with pytest.raises(Exception, match="no encoder 'none'; there are len, vow"):
        REGISTRY.vectors(spark.createDataFrame([(1, "x", "none")], "i int, text string, model string"), "text").collect()
    with pytest.raises(ValueError):
        ModelRegistry([ModelSpec("a", "encoder", lengths), ModelSpec("a", "reranker", overlap)])


def test_registered_models_as_providers(spark):
    index = spark.createDataFrame([("GSE1", "lung cell", [9.0, 1.0]), ("GSE2", "lung lung", [1.0, 9.0]), ("GSE3", "skin", [5.0, 5.0])], "gse_id string, document_text string, vec array<double>")
    for key, first in (("cross", "GSE1"), ("minus", "GSE3")):
        p = Providers(encoder=REGISTRY.encoder("len"), reranker=REGISTRY.reranker(key))
        out = retrieve(index, "lung cell", p.encoder.encode("lung cell"), RetrievalSpec(), providers=p)
        assert out.orderBy("rank").first().gse_id == first
    v = REGISTRY.encoder("len").column(index, "document_text", "v").orderBy("gse_id").first().v
    assert v == [len("doc:lung cell"), 1.0]


def test_only_the_last_used_models_stay():
    from quarry import providers

    few = ModelRegistry([ModelSpec(f"m{i}", "encoder", lengths) for i in range(5)], keep=2)
    for i in (0, 1, 0, 2):
        few.encode("x", f"m{i}")
    mine = [k[0] for k in providers._loaded if k[0].startswith("encoder:m")]
    assert mine == ["encoder:m0", "encoder:m2"]


LINES = [{"message": {"content": "Él "}}, {"message": {"content": "said"}}, {"response": " so"}, {"message": {}}, {"message": {"content": ""}, "done": True, "model": "m:1", "eval_count": 3, "prompt_eval_count": 7, "total_duration": 2_500_000}]
BODY = "\n".join(["", *(json.dumps(x, ensure_ascii=False) for x in LINES[:2]), "{broken", "[1]", *(json.dumps(x) for x in LINES[2:])]).encode() + b'\n\xff{"message": {"content": "lost"}}\n'


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_streams_that_are_cut_anywhere(spark, size):
    pieces = [BODY[i : i + size] for i in range(0, len(BODY), size)]
    assert list(ndjson(pieces)) == LINES
    s = TokenStream(pieces)
    assert list(s) == ["Él ", "said", " so"]
    e = envelope(spark.createDataFrame([s.call], "response string, fallback_used boolean, model string, eval_tokens int, prompt_tokens int, duration_ns long, error string")).first()
    assert (e.response_text, e.model, e.eval_tokens, e.prompt_tokens, e.duration_ms, e.failure_class, e.empty_content) == ("Él said so", "m:1", 3, 7, 2.5, "none", False)


def test_a_stream_that_breaks_keeps_what_came():
    def pieces():
        yield BODY[:40]
        raise TimeoutError("read timeout")

    s = TokenStream(pieces(), "m")
    with pytest.raises(TimeoutError):
        list(s)
    assert s.call["response"] == "Él " and "TimeoutError" in s.call["error"]


class Site(BaseHTTPRequestHandler):
    """Files with ranges, one without, parts that fail a few times, and a chat service."""

    body = bytes(i * 7 % 251 for i in range(100_000))
    failing: dict[str, int] = {}
    seen: list[str] = []

    def log_message(self, *_):
        pass

    def do_HEAD(self):
        self._send(*((200, self.body) if self.path.endswith(".bin") else (404, b"")), body=False)

    def do_GET(self):
        part = self.headers.get("Range")
        if not self.path.endswith(".bin"):
            return self._send(404, b"")
        if not part or "plain" in self.path:
            type(self).seen.append("whole")
            return self._send(200, self.body)
        type(self).seen.append(part)
        a, b = part.split("=")[1].split("-")
        if self.failing.get(part, 0) > 0:
            self.failing[part] -= 1
            return self._send(500, b"")
        return self._send(206, self.body[int(a) : int(b) + 1 if b else None])

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        type(self).seen.append(asked["messages"][-1]["content"])
        self._send(200, BODY)

    def _send(self, code, data, body=True):
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if body:
            self.wfile.write(data)


@pytest.fixture()
def site():
    Site.failing, Site.seen = {}, []
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_answers_over_http(site):
    g = HttpGenerator(site, "m", system="short")
    assert g.answer("why?") == "Él said so" and list(g.stream("and?")) == ["Él ", "said", " so"] and Site.seen == ["why?", "and?"]


def test_one_file_in_parts_over_tasks(spark, site, tmp_path):
    f = acquire.HttpFetcher()
    files = spark.createDataFrame([("GSE1", f"{site}/a.bin"), ("GSE2", f"{site}/plain.bin"), ("GSE3", f"{site}/none.txt")], "series_id string, url string")
    target, progress = str(tmp_path / "got"), str(tmp_path / "progress")
    Site.failing = {"bytes=30000-59999": 1}
    got = {r.series_id: r for r in acquire.download_ranged(files, f, target, progress, part_bytes=30_000, retries=1, wait=0).collect()}
    assert not got["GSE1"].ok and "500" in got["GSE1"].error and got["GSE2"].ok and got["GSE3"].error == "HTTP 404"
    assert (tmp_path / "got" / "GSE2" / "plain.bin").read_bytes() == Site.body and not (tmp_path / "got" / "GSE1" / "a.bin").exists()
    rows = spark.read.parquet(progress)
    assert rows.where("series_id = 'GSE1'").count() == 4 and rows.agg(F.sum("done")).first()[0] == 170_000
    Site.seen.clear()
    again = {r.series_id: r for r in acquire.download_ranged(files.where("series_id = 'GSE1'"), f, target, progress, part_bytes=30_000, retries=1, wait=0).collect()}
    assert again["GSE1"].ok and (tmp_path / "got" / "GSE1" / "a.bin").read_bytes() == Site.body
    assert [x for x in Site.seen if x != "bytes=0-0"] == ["bytes=30000-59999"]  # the failed part alone
    assert sorted(p.name for p in (tmp_path / "got" / "GSE1").iterdir()) == ["a.bin"]


def test_parts_of_files_in_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "f.bin").write_bytes(Site.body)
    (tmp_path / "src" / "empty.bin").write_bytes(b"")
    files = spark.createDataFrame([("GSE1", "x/f.bin"), ("GSE1", "x/empty.bin")], "series_id string, url string")
    got = acquire.download_ranged(files, acquire.FolderFetcher(str(tmp_path / "src")), str(tmp_path / "got"), str(tmp_path / "p"), part_bytes=33_333).collect()
    assert all(r.ok for r in got) and (tmp_path / "got" / "GSE1" / "f.bin").read_bytes() == Site.body and (tmp_path / "got" / "GSE1" / "empty.bin").read_bytes() == b""


def test_joining_of_small_rows_is_dealt_over_tasks(spark, tmp_path):
    rows = [(f"GSE{i}", f"http://x/f{i}", 1, 0, "gone") for i in range(100)]
    got = acquire.join_ranges(spark.createDataFrame(rows, "series_id string, url string, size long, part int, error string"), str(tmp_path))
    assert got.count() == 100 and got.select(F.spark_partition_id()).distinct().count() > 4


class Breaking(acquire.FolderFetcher):
    """Gives parts, but none that begins at a mark's place while the mark is there."""

    def read_range(self, url, start, stop):
        if start == 128 and self.path("broken").exists():
            raise OSError("no part")
        yield from self.read(url, start)


def test_small_files_are_put_to_their_place_at_once(spark, tmp_path):
    f = Breaking(str(tmp_path / "src"), fan=8)
    names = [f"f{i}.txt" for i in range(50)]
    for name in names + ["broken"]:
        f.path(name).parent.mkdir(parents=True, exist_ok=True)
        f.path(name).write_text(name * 40)
    assert len(list((tmp_path / "src").iterdir())) == 8
    files = spark.createDataFrame([(f"GSE{i % 7}", f"http://x/{n}") for i, n in enumerate(names)], "series_id string, url string")
    target = tmp_path / "whole"
    plan = acquire.plan_ranges(files, f, 64).localCheckpoint()
    assert plan.count() > 3 * len(names)
    f.path("broken").unlink()
    got = acquire.fetch_ranges(plan, f, str(target)).collect()
    assert all(r.done == r.fetched == r.stop - r.start and not r.error for r in got)
    assert sorted(p.name for p in target.rglob("*.txt*")) == sorted(names)  # no parts, nothing to join
    assert all((target / f"GSE{i % 7}" / n).read_text() == n * 40 for i, n in enumerate(names))
    again = acquire.fetch_ranges(plan, f, str(target)).agg(F.sum("fetched")).first()[0]
    assert again == 0
    # a part that doesn't come leaves the others beside the file, and only it is fetched afterwards
    target = str(tmp_path / "broken")
    f.path("broken").write_text("")
    bad = acquire.download_ranged(files, f, target, str(tmp_path / "p"), part_bytes=64, retries=1, wait=0).collect()
    assert len(bad) == 50 and all("no part" in r.error for r in bad) and not list((tmp_path / "broken").rglob("*.txt"))
    f.path("broken").unlink()
    left = acquire.fetch_ranges(plan, f, target).where("fetched > 0").select("start").distinct().collect()
    assert [r.start for r in left] == [128]
    assert all(r.ok for r in acquire.download_ranged(files, f, target, str(tmp_path / "p"), part_bytes=64).collect())
    assert all((tmp_path / "broken" / f"GSE{i % 7}" / n).read_text() == n * 40 for i, n in enumerate(names)) and not list((tmp_path / "broken").rglob("*.part*"))
