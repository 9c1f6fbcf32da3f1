"""The engine with models: tiers, parsing, refining, compressing, streaming, extraction, the evaluation loop; versions, layout and commands."""

from __future__ import annotations

import json
import threading
from http.server import ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.config import Config
from quarry.engine import Engine
from quarry.plans import evaluate
from quarry.providers import Providers
from tests.test_models_and_ranges import BODY, Site
from tests.test_plans import studies

ASKED: list[tuple[str, str]] = []


class Model:
    """A stand-in for a language model that answers by what it is asked for."""

    def __init__(self, name):
        self.name = name

    def answer(self, prompt):
        ASKED.append((self.name, prompt))
        if prompt.startswith("Give the constraints"):
            return 'Sure: {"organism": "Homo sapiens", "free_text": "lung cells"}'
        if prompt.startswith("Query:") and "more specific" in prompt:
            return "sample number 5"
        if prompt.startswith("In at most"):
            return "SHORT"
        if self.name == "qwen3.5-9b":
            raise TimeoutError("timeout")
        return f"{self.name} says {prompt.count('GSE')}"

    def stream(self, prompt):
        yield "one "
        yield self.name
        if self.name == "broken":
            raise TimeoutError("cut")


@pytest.fixture()
def engine(spark, tmp_path):
    ASKED.clear()
    names = frozenset({"llama3.1-8b", "qwen2.5-1.5b", "qwen2.5-0.5b", "qwen3.5-9b"})
    e = Engine(spark, Config(root=str(tmp_path), tier=""), Providers(models=Model, registered=names))
    e.index(studies(spark, 8))
    return e


def test_tiers_choose_models_forms_and_strategies(engine):
    out = engine.answer("lung of humans", tier="quality")
    assert ASKED[0][0] == "llama3.1-8b" and ASKED[0][1].startswith("Give the constraints")
    assert [n for n, _ in ASKED[1:]] == ["qwen3.5-9b", "qwen2.5-1.5b"]  # the tier's model failed, the default answered
    g = out["generation"]
    assert g["fallback_used"] and g["model"] == "qwen2.5-1.5b" and g["parse_status"] == "no_json" and len(g["raw_output_sha1"]) == 40
    prompt = ASKED[1][1]
    assert "Organism: Homo sapiens" in prompt and prompt.count("  Organism: ") == 3 and "Retrieval score" not in prompt  # three results in the tier's form
    ASKED.clear()
    assert engine.answer("lung", tier="fast")["answer"].startswith("qwen2.5-1.5b says")
    assert engine.answer("lung", compressed=True)["answer"].startswith("qwen2.5-1.5b says") and any(p.startswith("In at most") for _, p in ASKED)
    assert any("SHORT" in p for n, p in ASKED)


def test_all_models_failing_leaves_what_the_results_say(spark, engine):
    def broken(name):
        class M:
            def answer(self, prompt):
                raise OSError("no model")

        return M()

    e = Engine(spark, engine.config, Providers(models=broken, registered=frozenset({"a"})))
    out = e.answer("lung cells")
    assert out["answer"].startswith('## Results for: "lung cells"') and out["generation"]["failure_class"] == "error" and out["generation"]["empty_content"]
    assert e.parse("human lung")["organism"] == "Homo sapiens"  # rules


def test_steps_and_streams(engine):
    one = {r.gse_id for r in engine.retrieve("Study 1").collect()}
    two = engine.retrieve("Study 1", steps=2).collect()
    assert any("more specific" in p for _, p in ASKED) and len({r.gse_id for r in two}) == len(two) and one
    assert list(engine.stream("lung", tier="fast")) == ["one ", "qwen2.5-1.5b"]
    engine.router.registered.add("broken")
    engine.router.update("answer_generation", "broken")
    got = list(engine.stream("lung"))
    assert got[:2] == ["one ", "broken"] and got[2].startswith("## Results for")


def test_extraction_asks_in_batches_and_stands_failures(spark):
    class Many:
        calls: list[int] = []

        @staticmethod
        def many(prompts):
            if len(prompts) > 1 and any("bad" in p for p in prompts):
                raise OSError("together")
            if any("bad" in p for p in prompts):
                raise OSError("alone")
            return [json.dumps({"tissues": ["lung"], "diseases": []}) if "lung" in p else "nothing" for p in prompts]

    from quarry.plans.answer import extract_metadata

    rows = spark.createDataFrame([("a", "lung", "s"), ("b", "bad", None), ("c", None, "x"), ("d", "lung", "lung")], "gse_id string, title string, summary string").coalesce(1)
    got = {r.gse_id: r.tissues for r in extract_metadata(rows, Many, batch=2).collect()}
    assert got == {"a": ["lung"], "b": [], "c": [], "d": ["lung"]}


def items(spark, n=6):
    rows = [(d, c, "boolean", "answer", 0, f"{d}{i}", json.dumps({"question": f"q{i}", "answer": "true"})) for d, c in (("d1", "general"), ("d2", "general"), ("d3", "other")) for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, category string, evaluator string, answer_field string, shift int, item_id string, item string")


def test_a_panel_that_was_stopped_goes_on(spark, tmp_path):
    asked, root = spark.sparkContext.accumulator(0), str(tmp_path)

    def of(name):
        if name == "m2" and not (tmp_path / "go").exists():
            raise KeyboardInterrupt("killed")

        def call(prompt):
            asked.add(1)
            return "yes" if name == "m1" else "no"

        return call

    with pytest.raises(KeyboardInterrupt):
        evaluate.run_panel(spark, root, items(spark), of, ["m1", "m2"])
    assert asked.value == 18
    (tmp_path / "go").write_text("")
    got = evaluate.run_panel(spark, root, items(spark), of, ["m1", "m2", "m3"], available={"m1", "m2"}, most=4)
    assert asked.value == 18 + 12  # the first model isn't asked again; four items of each dataset
    assert {(r.label, r.dataset): (r.n_samples, r.accuracy) for r in got.collect()} == {(m, d): (n, a) for m, n, a in (("m1", 6, 1.0), ("m2", 4, 0.0)) for d in ("d1", "d2", "d3")}
    records = evaluate.run_records(evaluate.category_composites(got, ["model", "category"]))
    assert {r.model: dict(r.composites) for r in records.collect()} == {"m1": {"general": 1.0, "other": 1.0}, "m2": {"general": 0.0, "other": 0.0}}
    with pytest.raises(evaluate.PanelIncomplete):
        evaluate.run_panel(spark, str(tmp_path / "x"), items(spark), of, ["m9"], available=set())


def test_the_public_panel_is_frozen_and_closed(spark, tmp_path):
    with pytest.raises(evaluate.PanelIncomplete, match="llama3.1-8b"):
        evaluate.run_panel(spark, str(tmp_path), items(spark, 1), lambda m: lambda p: "yes", available={"qwen2.5-0.5b"})
    assert len(evaluate.PUBLIC_PANEL) == 11 and evaluate.PUBLIC_PANEL[0] == "qwen2.5-0.5b"
    calls = []
    of = lambda m: calls.append(m) or (lambda p: "yes")
    done = evaluate.run_panel(spark, str(tmp_path), items(spark, 1).where("dataset = 'd1'"), of, available=set(evaluate.PUBLIC_PANEL))
    assert calls == list(evaluate.PUBLIC_PANEL) and done.select("label").distinct().count() == 11
    evaluate.run_panel(spark, str(tmp_path), items(spark), of, ["another"])
    assert len(calls) == 11  # closed


def test_studies_are_rewritten_as_a_version(spark, tmp_path):
    root = tmp_path / "data"
    (root / "studies").mkdir(parents=True)
    rows = [{"gse_id": f"GSE{i}", "title": "t", "tissues": ["Lung", "odd"] if i else [], "extra": {"kept": [i]}, "ontology_mappings": {"old": 1}} for i in range(3)]
    (root / "studies" / "a.json").write_text("\n".join(json.dumps(r) for r in rows[:2]))
    (root / "studies" / "b.json").write_text(json.dumps(rows[2], indent=2))
    (tmp_path / "onto").mkdir()
    (tmp_path / "onto" / "uberon-basic.obo").write_text("[Term]\nid: UBERON:1\nname: Lung\n")
    e = Engine(spark, Config(root=str(root)))
    assert e.studies().count() == 3
    before = e.studies()
    assert cli.main(["--root", str(root), "ontology", str(tmp_path / "onto")], spark) == 0
    docs = {d["gse_id"]: d for d in (json.loads(r.d) for r in e.study_documents().select(F.to_json("doc").alias("d")).collect())}
    assert docs["GSE1"]["extra"] == {"kept": [1]} and docs["GSE1"]["ontology_mappings"]["tissue"][0]["ontology_id"] == "UBERON:1"
    assert "ontology_mappings" not in docs["GSE0"] and before.count() == 3
    (root / "studies" / "c.json").write_text(json.dumps({"gse_id": "GSE9"}))
    assert {r.gse_id for r in e.studies().collect()} == {"GSE0", "GSE1", "GSE2", "GSE9"}
    assert len(e._versions("studies_mapped").history()) == 1


def test_layout_by_link_copy_and_move(spark, tmp_path):
    for i in (1, 2, 3):
        (tmp_path / "in" / f"GSE{i}_x").mkdir(parents=True)
        (tmp_path / "in" / f"GSE{i}_x" / "counts.csv").write_text("id,a\n")
    texts = spark.createDataFrame([("GSE1", "lung cancer tumor", "", ""), ("GSE2", "embryonic development of the heart", "", "")], "series_id string, title string, summary string, overall_design string")
    for mode in ("symlink", "copy", "move"):
        e = Engine(spark, Config(root=str(tmp_path / mode)))
        placed = {r.series_id: r for r in e.lay_out(str(tmp_path / "in"), texts, mode).collect()}
        assert {r.status for r in placed.values()} == {mode} and placed["GSE1"].target.endswith("/cancer/lung/GSE1") and placed["GSE3"].domain == "unknown"
        assert all((tmp_path / mode / "themed" / r.domain / r.organ / s / "counts.csv").exists() for s, r in placed.items())
        summary = json.loads(next((tmp_path / mode / "theme_summary").glob("*.json")).read_text())
        assert (summary["total"], summary["created"], summary["skipped"], summary["mode"]) == (3, 3, 0, mode)
        if mode != "move":
            assert {r.status for r in e.lay_out(str(tmp_path / "in"), texts, mode).collect()} == {"exists"}
    assert not list((tmp_path / "in").iterdir())
    with pytest.raises(ValueError):
        Engine(spark, Config(root=str(tmp_path))).lay_out(str(tmp_path / "in"), None, "zip")


def test_commands_with_models_and_text(spark, tmp_path, capsys):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_address[1]}"
    root = str(tmp_path / "r")
    Engine(spark, Config(root=root)).index(studies(spark, 3))
    run = lambda *w: cli.main(["--root", root, "--log", str(tmp_path / "log"), *w], spark)
    run("--models", site, "answer", "lung", "--stream")
    assert "Él said so" in capsys.readouterr().out and list((tmp_path / "log").iterdir()) and BODY
    series = [{"series_id": "GSE1", "title": "tumor cancer scRNA-seq", "organism": "Homo sapiens", "supplementary_files": ["http://h/counts.csv", "http://h/x.rds"]}, {"gse_id": "GSE2", "title": "", "supplementary_files": []}]
    (tmp_path / "saved.json").write_text(json.dumps(series, indent=1))
    run("scan", str(tmp_path / "saved.json"), "--text", "--save", str(tmp_path / "kept"))
    out = capsys.readouterr().out
    assert "GSE1  CANCER  [RNA]" in out and "(no title)" in out and spark.read.json(str(tmp_path / "kept")).count() == 2
    (tmp_path / "files.json").write_text(json.dumps({"series_id": "GSE1", "pos": 0, "url": f"{site}/a.bin"}) + "\n" + json.dumps({"series_id": "GSE1", "pos": 1, "url": f"{site}/no"}))
    run("verify", str(tmp_path / "files.json"), "--text")
    out = capsys.readouterr().out
    assert "+ a.bin" in out and "97.7 KB" in out and "HTTP 404" in out and "1/2 accessible" in out
    with pytest.raises(SystemExit):
        run("download", str(tmp_path / "files.json"), "--target", str(tmp_path / "t"), "--domain", "cancer")
    server.shutdown()


def test_commands_of_flows(spark, tmp_path, capsys):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_address[1]}"
    root = tmp_path / "r"
    (root / "studies").mkdir(parents=True)
    (root / "studies" / "a.json").write_text(json.dumps({"gse_id": "GSE1", "title": "t"}))

    def run(*words):
        assert cli.main(["--root", str(root), *words], spark) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("--models", site, "extract") == [{"gse_id": "GSE1", "tissues": [], "diseases": [], "cell_types": []}]
    (tmp_path / "in" / "GSE7").mkdir(parents=True)
    (tmp_path / "in" / "GSE7" / "x.csv").write_text("id,a\n")
    got = run("layout", str(tmp_path / "in"), "--mode", "copy")
    assert [(r["series_id"], r["domain"], r["status"]) for r in got] == [("GSE7", "unknown", "copy")]
    (tmp_path / "registry.json").write_text(json.dumps({"dataset": "d", "category": "c", "evaluator": "boolean", "answer_field": "answer", "shift": 0}))
    (tmp_path / "sets" / "d").mkdir(parents=True)
    (tmp_path / "sets" / "d" / "part-0.json").write_text(json.dumps({"question": "q", "answer": "false"}))
    got = run("--models", site, "--registered", "m", "evaluate", str(tmp_path / "registry.json"), str(tmp_path / "sets"), "--models-of", "m")
    assert [(r["label"], r["dataset"], r["n_samples"], r["accuracy"]) for r in got] == [("m", "d", 1, 1.0)]  # no yes in the answer
    server.shutdown()
