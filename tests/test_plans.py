from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry import cli
from quarry.config import Config, load_config
from quarry.engine import Engine
from quarry.plans import answer, enrich, evaluate, index, models, reports, retrieve
from quarry.providers import HashingEncoder, Providers, TemplateGenerator, hash_vector, with_fallback
from quarry.sources import records
from quarry.sources.soft import parse_samples
from tests.test_sources import SAMPLES, SERIES, texts


def studies(spark, n=6):
    rows = [
        {"gse_id": f"GSE{i}", "title": f"Study {i} of lung cells", "summary": f"A summary about sample number {i} of the lung" if i % 2 else "short", "organism": "Homo sapiens" if i % 3 else "Mus musculus", "n_samples": i, "tissues": ["lung", "liver"][: i % 3], "diseases": ["flu"] if i % 2 else [], "modalities": ["scRNA-seq"]}
        for i in range(n)
    ]
    raw = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", records.STUDY).alias("s")).select("s.*")
    return records.shape_studies(raw)


def test_enrichment_chain(spark):
    from quarry.sources.soft import parse_samples, parse_series

    series = parse_series(texts(spark, ("GSE1", SERIES), ("GSE2", "!Series_title = lonely")))
    articles = spark.createDataFrame([("7", "Paper", "Abstract text", ["Lung"], [])], "pmid string, title string, abstract string, mesh_terms array<string>, keywords array<string>")
    manifest = spark.createDataFrame([("GSE2", "ignored", "from manifest about tumor", "Other")], "series_id string, title string, summary string, series_type string")
    got = {r.series_id: r for r in enrich.enrich(series, parse_samples(texts(spark, ("GSE1", SAMPLES.rpartition("^SAMPLE")[0]))), articles, manifest).collect()}
    a, b = got["GSE1"], got["GSE2"]
    assert a.tissues == ["left: lung", "lung"] and a.age_range == "42-42" and a.organism == "Homo sapiens" and a.pubmed.pmid == "7"
    assert a.modalities == ["scRNA-seq", "other"] and "Abstract: Abstract text" in a.document_text
    assert (b.title, b.summary, b.series_type, b.domain, b.n_samples, b.tissues) == ("lonely", "from manifest about tumor", "Other", "cancer", 0, [])


def test_characteristics_ignore_missing_values(spark):
    s = spark.createDataFrame([("A", {"tissue": "N/A", "cell type": "T", "donor": "d1", "age": "P12-14"}, "na", ""), ("A", {"donor": "D1", "sex": "F", "gender": "f", "odd": "x"}, "Blood", "Human")], "series_id string, characteristics map<string,string>, source string, organism string")
    r = enrich.summarize_characteristics(s).first()
    assert (r.tissues, r.cell_types, r.sex, r.donor_count, r.age_range, r.organisms) == (["blood"], ["t"], ["f"], 2, "12-12", ["Human"])


def test_retrieval_arms_and_filters(spark):
    p = Providers(HashingEncoder(32))
    idx = index.encode(index.payload(studies(spark)), p).cache()
    q = "Study 3 sample number"
    run = lambda s, n=4, **k: [r.gse_id for r in retrieve.retrieve(idx, q, p.encoder.encode(q), retrieve.RetrievalSpec(strategy=s, rerank_k=n, **k), {"organism": "Homo sapiens"}, p).orderBy("rank").collect()]
    assert len(run("hybrid+filter+rerank")) == 4 and run("sparse")[0] == "GSE3"
    assert not {"GSE0", "GSE3"} & set(run("dense+filter")) and not {"GSE0", "GSE3"} & set(run("hybrid+filter", filter_scope="both"))
    assert "GSE3" in run("hybrid+filter", 6)  # only the dense arm is filtered by default
    out = retrieve.multi_step(idx, q, refine=lambda query, titles: "lung cells flu", providers=p)
    assert out.count() == 6 and retrieve.multi_step(idx, q, refine=lambda *_: "abc", providers=p).count() == 6
    assert retrieve.multi_step(idx, q, refine=lambda *_: 1 / 0, providers=p).count() == 6
    idx.unpersist()


def test_contexts_and_answers(spark):
    s = studies(spark).withColumn("rank", F.regexp_extract("gse_id", r"(\d+)", 1).cast("int") + 1).withColumn("dense_score", F.lit(0.5)).withColumn("rerank_score", F.lit(0.0))
    lines = [r[0] for r in s.orderBy("rank").select(answer.context_text()).collect()]
    assert lines[1] == "[2] GSE1: Study 1 of lung cells\n  Organism: Homo sapiens | Tissues: lung | Diseases: flu\n"
    assert s.where("rank = 1").select(answer.context_text("minimal")).first()[0] == "[1] GSE0: Study 0 of lung cells | N/A | N/A"
    assert "Cell types: " in s.where("rank = 2").select(answer.context_text("full")).first()[0]
    assert [r["rank"] for r in answer.within_budget(s, budget=len(lines[0]) // 4 + 1).collect()] == [1]
    kinds = {(r.gse_id, r.chunk_type) for r in answer.field_chunks(s).collect()}
    assert ("GSE1", "summary") in kinds and ("GSE0", "summary") not in kinds and ("GSE0", "metadata") not in kinds
    text = answer.fallback_answer(s, "q").first()[0]
    assert text.startswith('## Results for: "q"\n\nFound **6 datasets**') and "### 2. GSE1" in text and "**Relevance score**: 0.500" in text
    assert answer.fallback_answer(s.where("false"), "q").first()[0] == "No datasets found matching: q"
    assert with_fallback([lambda _: 1 / 0, lambda _: " ok "], "p") == "ok" and with_fallback([lambda _: 1 / 0], "p") is None
    assert "".join(TemplateGenerator().stream("a b")).strip() == "a b"


def test_envelopes(spark):
    rows = [('{"a": 1}', "", 1_500_000), ("", "Read timeout", 0), (" ", "", None)]
    calls = spark.createDataFrame(rows, "response string, error string, duration_ns long").withColumns({"fallback_used": F.lit(None).cast("boolean"), "model": F.lit("m"), "eval_tokens": F.lit(1), "prompt_tokens": F.lit(2)})
    a, b, c = answer.envelope(calls).collect()
    assert (a.parse_status, a.duration_ms, len(a.raw_output_sha1), a.json) == ("ok", 1.5, 40, '{"a": 1}')
    assert (b.failure_class, b.parse_status, b.raw_output_sha1) == ("timeout", "not_attempted", "") and c.empty_content and c.parse_status == "no_json"


def test_reports(spark, tmp_path):
    local = spark.createDataFrame([("GSE1", "GSM1_counts.csv", 5), ("GSE1", "x.h5ad", 7)], "series_id string, name string, size_bytes long")
    remote = spark.createDataFrame([("GSE1", 1, "http://b/x.h5ad"), ("GSE1", 0, "http://a/x.h5ad/")], "series_id string, pos int, url string")
    rows = reports.manifest_files(local, remote)
    assert {r.name: r.source_url for r in rows.collect()} == {"GSM1_counts.csv": "", "x.h5ad": "http://a/x.h5ad/"}
    series = spark.createDataFrame([("GSE1", "Lung cancer tumor", "", None, "", "")], "series_id string, title string, summary string, overall_design string, organism string, series_type string")
    reports.write_manifests(series, rows, str(tmp_path / "m"))
    m = spark.read.json(str(tmp_path / "m")).first()
    assert m.summary.total_local_files == 2 and m.summary.has_h5ad and len(m.files) == 2 and m.generated_at.endswith("Z")
    assert reports.themes(series).first() == ("GSE1", "cancer", "lung")
    reports.write_theme_layout(local, series, str(tmp_path / "t"))
    assert (tmp_path / "t" / "domain=cancer" / "organ=lung").exists()
    cand = spark.createDataFrame([("brain", i, f"GSE{i}", "t", "human", "cancer" if i != 2 else "normal", ["rna"], "h5ad") for i in range(9)] + [("lung", 1, "GSE1", "t", "human", "cancer", ["rna"], "h5ad")], "organ string, pos int, series_id string, title string, organism string, domain string, modalities array<string>, available_formats string")
    from quarry.operators.rules import classify_files

    files = classify_files(spark.createDataFrame([(f"GSE{i}", 0, "a.h5ad") for i in range(8)], "series_id string, pos int, url string"))
    gaps = {r.organ: r.candidates for r in reports.organ_gaps(series, cand, files, ["h5ad"]).collect()}
    assert "lung" not in gaps and len(gaps) == 17 and gaps["liver"] is None and [c.series_id for c in gaps["brain"]] == ["GSE0", "GSE1", "GSE3", "GSE4", "GSE5"]


def test_scorers(spark):
    rows = [
        ("mcq_index", "answer", 0, '{"answer": 2}', "C", True, 1, None),
        ("mcq_index", "answer", 0, '{"answer": 4}', "C", False, 0, None),
        ("mcq_index", "answer", 0, '{"answer": "x"}', "C", True, 0, None),
        ("mcq_letter", "answerKey", 0, '{"answerKey": "b"}', "b it is B", True, 1, None),
        ("mcq_index_str", "label", -1, '{"label": "1"}', "A.", True, 1, None),
        ("mcq_index_str", "label", 0, '{"label": "9"}', "A.", True, 0, None),
        ("binary_choice", "answer", 0, '{"answer": "2"}', "Option 2", True, 1, None),
        ("boolean", "answer", 0, '{"answer": true}', "Yes.", True, 0, None),
        ("boolean", "answer", 0, '{"answer": true}', "yes it is", True, 1, None),
        ("boolean", "answer", 0, '{"answer": false}', "no", True, 1, None),
        ("gsm8k", "answer", 0, '{"answer": "so #### 1,200"}', "it is 1200", True, 1, None),
        ("truthfulqa", "x", 0, '{"mc1_targets": {"choices": ["a", "b"], "labels": [1, 0]}}', "", True, 1, None),
        ("truthfulqa", "x", 0, '{"mc1_targets": {"choices": [], "labels": []}}', "A", False, 0, None),
        ("pubmedqa", "final_decision", 0, '{"final_decision": "maybe"}', "Unclear", True, 1, None),
        ("token_f1", "answers", 0, '{"answers": {"text": ["a b"]}}', "b", True, 0, 2 / 3),
        ("ifeval", "x", 0, '{"instruction_id_list": ["punctuation:no_comma", "length:number_words"]}', "a, b", True, 0, 0.5),
        ("json_schema", "x", 0, "{}", 'ok {"a": 1}', True, 1, None),
        ("nexus_fc", "x", 0, '{"python_function_name": "Go"}', "go(1)", True, 1, 1.0),
        ("nexus_fc", "x", 0, '{"python_function_name": "go"}', "run(1)", True, 1, 0.0),
        ("toolace", "x", 0, "{}", "plain", True, 0, 0.0),
    ]
    items = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "item_id long, evaluator string, answer_field string, shift int, item string, response string, c boolean, k int, s double")
    for r in evaluate.score_items(items).orderBy("item_id").collect():
        assert r.counted == r.c, r
        assert not r.c or (r.correct == r.k and (r.score == pytest.approx(r.s) if r.s is not None else r.score is None)), r
    choices = F.array(*(F.lit(c) for c in "wxyz"))
    order = spark.range(3).select("id", evaluate.shuffled_choices(F.col("id"), choices).alias("c")).collect()
    assert all(sorted(r.c) == list("wxyz") for r in order)
    item = '{"distractor1": "w", "distractor2": "x", "distractor3": "y", "correct_answer": "z"}'
    sciq = spark.createDataFrame([(i, "sciq", "a", 0, item, "ABCD"[order[i].c.index("z")]) for i in range(3)], "item_id long, evaluator string, answer_field string, shift int, item string, response string")
    assert [r.correct for r in evaluate.score_items(sciq).collect()] == [1, 1, 1]
    prompt = spark.range(1).select(evaluate.mcq_prompt(F.lit("Q?"), choices, F.lit("ctx"))).first()[0]
    assert prompt.startswith("Context: ctx\nQuestion: Q?\nA. w\nB. x") and prompt.endswith("(A, B, C, or D).")
    comp = spark.createDataFrame([("m", "c1", 0.5), ("m", "c2", 1.0)], "model string, category string, composite double")
    assert evaluate.run_records(comp).first().composites == {"c1": 0.5, "c2": 1.0}


def test_model_routing(spark):
    r = models.Router({"llama3.1-8b", "d"}, "d")
    assert r.model("query_parsing") == "llama3.1-8b" and r.model("answer_generation") == "d" and r.model("x", "llama3.1-8b") == "llama3.1-8b"
    assert r.tier("nope") == models.TIERS["balanced"]
    r.update("query_parsing", "unknown")
    r.update("x", "d")
    assert r.model("query_parsing") == "llama3.1-8b" and r.model("x") == "d"
    reg = spark.createDataFrame([("k1", "a:latest", "f", 0), ("k2", "a", "g", 1)], "key string, full_name string, family string, pos int")
    fam = spark.createDataFrame([("f", "hint")], "family string, json_hint string")
    got = {x.name: (x.key, x.family, x.json_hint) for x in models.resolve_names(spark.createDataFrame([("a",), ("k2",), ("zz",)], "name string"), reg, fam).collect()}
    assert got == {"a": ("k1", "f", "hint"), "k2": ("k2", "g", ""), "zz": (None, "unknown", "")}


def test_engine_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "series").mkdir()
    (tmp_path / "samples").mkdir()
    (tmp_path / "onto").mkdir()
    for i in (1, 2):
        (tmp_path / "series" / f"GSE{i}.soft").write_text(SERIES.replace("A title", f"Lung atlas number {i}"))
        (tmp_path / "samples" / f"GSE{i}.soft").write_text(SAMPLES.rpartition("^SAMPLE")[0])
    (tmp_path / "onto" / "uberon-basic.obo").write_text('[Term]\nid: UBERON:1\nname: Lung\nsynonym: "pulmo" EXACT []\n')
    root = str(tmp_path / "data")
    assert cli.main(["--root", root, "enrich", str(tmp_path / "series"), str(tmp_path / "samples")], spark) == 0
    e = Engine(spark, Config(root=root))
    maps = {(r.gse_id, r.category): [(m.raw, m.id, m.method) for m in r.mappings] for r in e.normalize(e.studies(), str(tmp_path / "onto")).collect()}
    assert ("lung", "UBERON:1", "exact") in maps[("GSE1", "tissue")]
    assert cli.main(["--root", root, "embed"], spark) == 0
    assert e.stats().first() == (2, "green")
    assert {r.gse_id for r in e.retrieve("lung atlas number 2 human").collect()} == {"GSE1", "GSE2"}
    out = e.answer("lung atlas")
    assert out["retrieval_stats"]["total_results"] == 2 and "lung atlas" in out["answer"]
    cli.chat(e, ["/help", "/stats", "/detail GSE1", "", "/quit", "never"])
    said = capsys.readouterr().out
    assert "points_count" in said and '"gse_id":"GSE1"' in said
    again = e.reindex(e.studies().where("gse_id = 'GSE1'").withColumn("title", F.lit("new")))
    assert {r.gse_id: r.title for r in again.collect()} == {"GSE1": "new", "GSE2": "Lung atlas number 2 = x"}
    s = spark.createDataFrame([("GSE1", "tumor cancer", "scRNA", "Homo sapiens", "", ["RAW.tar"]), ("GSE2", "t", "", "", "", ["x.h5ad"])], "series_id string, title string, summary string, organism string, series_type string, supplementary_files array<string>")
    data, files = e.classify(s, texts(spark, ("GSE1", SAMPLES)))
    got = {r.series_id: r for r in data.collect()}
    assert got["GSE1"].is_convertible and got["GSE1"].domain == "cancer" and got["GSE1"].modalities == ["rna"] and got["GSE2"].has_h5ad
    assert [r.series_id for r in e.select(data, files, domain="cancer", organism="human")[0].collect()] == ["GSE1"]
    assert e.download_plan(files).count() >= 2
    (tmp_path / "mats").mkdir()
    (tmp_path / "mats" / "s.csv").write_text("id,a\nx,1\n")
    assert e.convert(str(tmp_path / "mats")).count() == 1


def test_configuration():
    c = load_config(env={"QUARRY_TOP_K": "7", "QUARRY_ROOT": "/r/"})
    assert c.top_k == 7 and c.path("index") == "/r/index"
    v = hash_vector("a b a", 8)
    assert sum(x * x for x in v) == pytest.approx(1) and hash_vector("", 4) == [0.0] * 4


def test_enrich_reads_its_samples_once(spark, tmp_path):
    sample = lambda i, *xs: "\n".join([f"^SAMPLE = GSM{i}", f"!Sample_title = s{i}", *xs])
    chars = lambda *xs: [f"!Sample_characteristics_ch1 = {x}" for x in xs]
    text = "\n".join([
        sample(1, "!Sample_source_name_ch1 = Lung", "!Sample_organism_ch1 = Homo sapiens", *chars("donor: a", "age: 5 years", "Donor: b", "free", "disease state=Flu", "also free")),
        sample(2, "!Sample_source_name_ch1 = None", *chars("donor: a", "age: 11")),
        sample(3),
    ])
    spark.createDataFrame([("GSE1", text), ("GSE2", "")], "series_id string, text string").write.parquet(str(tmp_path / "texts"))
    samples = parse_samples(spark.read.parquet(str(tmp_path / "texts")))
    assert {r.sample_id: r.characteristics for r in samples.collect()}["GSM1"] == {"donor": "b", "age": "5 years", "attr_0": "free", "disease state": "Flu", "attr_1": "also free"}
    empty = "title string, summary string, overall_design string, organism string, platform string, series_type string, submission_date string"
    series = spark.createDataFrame([(f"GSE{i}", *[""] * 7, ["x"], 0) for i in (1, 2)], f"series_id string, {empty}, pubmed_ids array<string>, n_samples int")
    out = enrich.enrich(series, samples)
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan parquet") == 1
    got = {r.gse_id: (r.n_samples, r.donor_count, r.age_range, r.tissues, r.diseases, r.organism) for r in out.collect()}
    assert got == {"GSE1": (3, 2, "5-11", ["lung"], ["flu"], "Homo sapiens"), "GSE2": (0, 0, "", [], [], "")}
