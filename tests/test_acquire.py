from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quarry.config import load_config
from quarry.plans import acquire, answer, evaluate
from tests.test_plans import studies


def test_links_and_downloads(spark, tmp_path):
    remote, target = tmp_path / "remote", tmp_path / "target"
    remote.mkdir()
    (remote / "a.csv").write_bytes(b"x" * 100_000)
    fetcher = acquire.FolderFetcher(str(remote))
    rows = spark.createDataFrame([("GSE1", "http://h/a.csv"), ("GSE1", "http://h/none.csv")], "series_id string, url string")
    got = {r.url: (r.status_code, r.accessible, r.size, r.error) for r in acquire.verify_links(rows, fetcher).collect()}
    assert got == {"http://h/a.csv": (200, True, 100_000, ""), "http://h/none.csv": (404, False, None, "HTTP 404")}
    done = {r.url: r.ok for r in acquire.download(rows, fetcher, str(target), wait=0).collect()}
    assert done == {"http://h/a.csv": True, "http://h/none.csv": False}
    assert (target / "GSE1" / "a.csv").stat().st_size == 100_000
    sizes = spark.createDataFrame([(1, None), (2, 5), (3, 10 * 1024**3)], "i int, size long")
    assert [r.i for r in acquire.within_limit(sizes, 5.0).orderBy("i").collect()] == [1, 2]


def test_resume_and_retries(tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(200)))
    calls = []

    class Flaky(acquire.FolderFetcher):
        def read(self, url, offset):
            calls.append(offset)
            yield from (p for p in [bytes(range(offset, min(200, offset + 90)))])
            if len(calls) < 3:
                raise OSError("cut")

    out = str(tmp_path / "out.bin")
    assert acquire.fetch_file(Flaky(str(tmp_path)), "u/f.bin", out, wait=0) and calls == [0, 90, 180]
    assert (tmp_path / "out.bin").read_bytes() == bytes(range(200))
    assert acquire.fetch_file(Flaky(str(tmp_path)), "u/f.bin", out, wait=0) and len(calls) == 3
    assert not acquire.fetch_file(acquire.FolderFetcher(str(tmp_path)), "u/none", out + "2", wait=0)


def test_archives_stay_in_their_folder(tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name in ("a/b.txt", "../evil.txt"):
            data = io.BytesIO(b"hi")
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, data)
    assert [p.rsplit("/", 2)[-2:] for p in acquire.unpack(str(tmp_path / "t.tar"), str(tmp_path / "x"))] == [["a", "b.txt"]]
    assert not (tmp_path / "evil.txt").exists()
    (tmp_path / "z.txt.gz").write_bytes(gzip.compress(b"text"))
    assert open(acquire.gunzip(str(tmp_path / "z.txt.gz"))).read() == "text"


def test_generators_behind_plans(spark):
    assert answer.parse_with(lambda p: '{"organism": "Mus", "tissue": null}', "q", {})["organism"] == "Mus"
    assert answer.parse_with(lambda p: "no json", "q", {})["free_text"] == "q"
    assert answer.parse_with(lambda p: 1 / 0, "q", {"free_text": "f"}) == {"free_text": "f"}
    assert answer.json_object('x {"a": {"b": 1}} {') == {"a": {"b": 1}} and answer.json_object("{bad}") is None and answer.json_object("[1]") is None
    s = studies(spark).withColumn("rank", F.lit(1))
    assert "GSE0" in answer.compress(s, "q", lambda p: p)
    got = answer.extract_metadata(s, lambda p: '{"tissues": ["lung"]}' if "Study 1" in p else "none").collect()
    assert {r.gse_id: (r.tissues, r.diseases) for r in got}["GSE1"] == (["lung"], []) and all(r.cell_types == [] for r in got)


def test_prompts(spark):
    rows = [
        ("mcq_letter", {"question": "Q", "choices": {"text": ["a", "b"]}}, "Question: Q\nA. a\nB. b"),
        ("mcq_index", {"question": "Q", "opa": "w", "opb": "x", "opc": "y", "opd": "z"}, "D. z"),
        ("binary_choice", {"sentence": "S", "option1": "o", "option2": "p"}, "S\n\n1. o\n2. p"),
        ("boolean", {"question": "Q", "passage": "p" * 900}, "Passage: " + "p" * 500 + "\n"),
        ("pubmedqa", {"question": "Q", "context": {"contexts": ["a", "b"]}}, "Context: a b\n"),
        ("truthfulqa", {"question": "Q", "mc1_targets": {"choices": ["a", "b"], "labels": [1, 0]}}, "B. b"),
        ("sciq", {"question": "Q", "distractor1": "a", "distractor2": "b", "distractor3": "c", "correct_answer": "d"}, "D. "),
        ("gsm8k", {"question": "Q"}, "####"),
        ("token_f1", {"question": "Q", "context": "ctx"}, "Context: ctx"),
        ("json_schema", {"prompt": [{"content": "x"}, {"content": "last"}]}, "last"),
        ("glaive_fc", {"chat": "USER: do it ASSISTANT: ok"}, "do it"),
        ("toolace", {"conversations": [{"value": "v"}]}, "v"),
        ("ifeval", {"prompt": "say"}, "say"),
    ]
    items = spark.createDataFrame([(i, e, json.dumps(x)) for i, (e, x, _) in enumerate(rows)], "item_id long, evaluator string, item string")
    got = evaluate.prompts(items)
    for r, (_, _, want) in zip(got.orderBy("item_id").collect(), rows, strict=True):
        assert want in r.prompt, (r.evaluator, r.prompt)
    said = evaluate.answer_items(got, lambda p: p.upper() if "say" in p else 1 / 0).orderBy("item_id").collect()
    assert said[-1].response == "SAY" and said[0].response is None


def test_configuration_file(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("top_k: 9\nroot: /a\nodd: 1\n")
    c = load_config(env={"QUARRY_ROOT": "/b"}, path=str(tmp_path / "c.yaml"))
    assert (c.top_k, c.root) == (9, "/b")


def test_commands(spark, tmp_path, capsys):
    from quarry import cli

    remote = tmp_path / "remote"
    remote.mkdir()
    (remote / "lung_counts.csv").write_text("id,g1\nc1,2\n")
    put = lambda name, *rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows))) and str(tmp_path / name)
    series = put("series.json", {"series_id": "GSE1", "title": "lung cancer tumor", "summary": "rna-seq", "overall_design": "", "organism": "Homo sapiens", "series_type": "", "supplementary_files": ["ftp://h/lung_counts.csv", "ftp://h/x.rds"], "organ": "brain", "pos": 0})
    files = put("files.json", {"series_id": "GSE1", "pos": 0, "url": "ftp://h/lung_counts.csv"}, {"series_id": "GSE1", "pos": 1, "url": "ftp://h/none.csv"})
    local = put("local.json", {"series_id": "GSE1", "name": "lung_counts.csv", "size_bytes": 3})
    root, target = str(tmp_path / "data"), str(tmp_path / "target")
    run = lambda *args: cli.main(["--root", root, *args], spark) or capsys.readouterr().out
    assert '"accessible_links":1' in run("verify", files, "--folder", str(remote))
    assert '"status":"partial"' in run("download", files, "--folder", str(remote), "--target", target)
    assert "manifests" in run("manifest", series, local) and "themes" in run("organize", series, local)
    assert '"organ":"brain"' in run("gap", f"{root}/manifests", series, "--format", "csv")
    out = run("run", series, "--folder", str(remote), "--target", target, "--domain", "cancer")
    assert '"series_id":"GSE1"' in out and '"sample":"lung_counts.csv"' in out
    assert '"series_id":"GSE1"' in run("scan", series, "--domain", "cancer") and run("scan", series, "--domain", "normal") == ""
