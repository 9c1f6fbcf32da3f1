"""Flows through the engine and its parts: classification with probes, conversion, archives, downloads, layouts, models, streams and saved forms."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import load_config
from quarry.engine import Engine
from quarry.plans.acquire import FolderFetcher, download_ranged
from quarry.plans.answer import CALL, envelope, extract_metadata
from quarry.plans.convert import convert_folder, local_path
from quarry.plans.evaluate import category_composites, run_panel, run_records
from quarry.plans.models import with_defaults
from quarry.plans.reports import dataset_lines, layout_folders, layout_summary, link_lines, series_status
from quarry.providers import ModelRegistry, ModelSpec, TokenStream
from quarry.queries.base import query
from quarry.queries.flows import _items, _sample_soft, _text
from quarry.runtime import Workspace
from quarry.sources.hdf5_writer import write_matrices
from quarry.sources.records import study_documents, with_mappings
from quarry.streaming.ingest import ingest_series
from quarry.tables import table


def _engine(spark: SparkSession, label: str) -> Engine:
    return Engine(spark, replace(load_config(env={}), root=Workspace(spark, label).root))


@query("""with h as (select o_custkey, count(*) filter (o_orderkey % 2 = 0) as probed from orders group by o_custkey)
select 'GSE' || c_custkey as series_id, c_name as title, coalesce(probed, 0) > 0 or c_custkey % 3 = 2 or c_custkey % 3 = 1 as is_convertible,
case when c_custkey % 3 = 0 then coalesce(probed, 0) else 0 end as probed from (select c.*, case when c_custkey % 3 = 0 then h.probed end as probed from customer c left join h on o_custkey = c_custkey)""")
def probed_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with an archive only get their samples' files probed; series fields stay beside the flags."""
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, F.array(F.lit("http://x/RAW.tar"))).when(k % 3 == 1, F.array(F.lit("http://x/umi_count_matrix.csv.gz"))).otherwise(F.array(F.lit("http://x/y.h5ad")))
    series = table(spark, sf_dir, "customer").select(_text("GSE", k).alias("series_id"), F.col("c_name").alias("title"), F.lit("").alias("summary"), F.lit("").alias("organism"), F.lit("").alias("series_type"), own.alias("supplementary_files"))
    data, files = Engine(spark).classify(series, _sample_soft(spark, sf_dir))
    n = files.where("probed").groupBy("series_id").agg(F.count("*").alias("probed"))
    return data.join(n, "series_id", "left").select("series_id", "title", "is_convertible", F.coalesce("probed", F.lit(0)).cast("long").alias("probed"))


@query("""select 'GSE' || s_nationkey as series_id, count(*) as entries, (select count(distinct s_nationkey) from supplier where s_suppkey != 0) as success from supplier where s_suppkey != 0 group by s_nationkey""")
def engine_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of series folders converted by the engine; its matrices are read by series, and its summary is JSON."""
    e = _engine(spark, "conversion")
    s = table(spark, sf_dir, "supplier").select(_text("GSE", F.col("s_nationkey")).alias("series_id"), _text("c", F.col("s_suppkey")).alias("cell"), F.lit("number").alias("gene"), F.col("s_suppkey").cast("double").alias("value"))
    Workspace(spark, "written").save(write_matrices(s, e.config.path("in")), "files")
    e.convert(e.config.path("in"))
    summary = spark.read.json(e.config.path("conversion_summary"))
    made = spark.read.parquet(e.config.path("matrices")).groupBy("series_id").agg(F.count("*").alias("entries"))
    return made.crossJoin(F.broadcast(summary.select(F.col("success").cast("long").alias("success"))))  # one row


@query("select 'GSE' || l_suppkey as series_id, 'c' || l_orderkey as cell, sum(l_linenumber)::double as value from lineitem where l_suppkey % 2 = 0 group by all")
def archived_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even suppliers in tar archives, one a series, unpacked and read by the conversion of folders."""
    ws = Workspace(spark, "archives")
    place = local_path(f"{ws.root}/in")
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 0").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_linenumber").alias("n"))

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        from pathlib import Path

        folder = Path(place) / f"GSE{b['l_suppkey'].iloc[0]}"
        folder.mkdir(parents=True, exist_ok=True)
        data = ("id,lines\n" + "".join(f"c{o},{n}\n" for o, n in zip(b["l_orderkey"], b["n"], strict=True))).encode()
        with tarfile.open(folder / "raw.tar.gz", "w:gz") as t:
            for name, body in (("0_empty.csv", b"id,lines\n"), ("deep/lines.csv", data), ("../out.csv", data)):
                info = tarfile.TarInfo(name)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return b[["l_suppkey"]].head(1)

    ws.save(rows.groupBy("l_suppkey").applyInPandas(pack, "l_suppkey long"), "packed")
    return convert_folder(spark, f"{ws.root}/in")[0].select("series_id", "cell", "value")


@query("""with f as (select o_custkey, 'f' || o_orderkey || '.txt' as name, o_orderkey % 5 != 0 as there from orders), s as (select o_custkey, count(*) as n, count(*) filter (there) as good from f group by o_custkey)
select 'GSE' || o_custkey as series_id, case when good = n then 'complete' when good > 0 then 'partial' else 'failed' end as status, good as files from s""")
def ranged_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of orders fetched in parts; every fifth isn't there."""
    ws = Workspace(spark, "downloads")
    fetcher = FolderFetcher(local_path(f"{ws.root}/source"), fan=256)
    o = table(spark, sf_dir, "orders")

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for b in batches:
            for k in b["o_orderkey"]:
                place = fetcher.path(f"f{k}.txt")
                if place.parent not in made:
                    place.parent.mkdir(parents=True, exist_ok=True)
                    made.add(place.parent)
                place.write_text(str(k) * 40)
            yield b

    ws.save(o.where("o_orderkey % 5 != 0").select("o_orderkey").repartition(64).mapInPandas(lay, "o_orderkey long"), "laid")
    files = o.select(_text("GSE", F.col("o_custkey")).alias("series_id"), _text("http://x/f", F.col("o_orderkey"), ".txt").alias("url"))
    got = download_ranged(files, fetcher, local_path(f"{ws.root}/target"), f"{ws.root}/progress", part_bytes=64, retries=1, wait=0)
    count = got.groupBy("series_id").agg(F.count_if("ok").alias("files"))
    return series_status(got).join(count, "series_id").select("series_id", "status", "files")


@query("""with p as (select s_suppkey, case when s_suppkey % 2 = 0 then 'cancer' else 'unknown' end as domain, case when s_suppkey % 2 = 0 then 'lung' else 'unknown' end as organ from supplier)
select 'GSE' || s_suppkey as series_id, domain, organ, 'symlink' as status, 'exists' as again, (select count(*) from supplier) as total from p""")
def placed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of suppliers linked by domain and organ, twice."""
    ws = Workspace(spark, "layout")
    base = local_path(ws.root)
    s = table(spark, sf_dir, "supplier").select(_text("GSE", F.col("s_suppkey")).alias("series_id"), F.col("s_suppkey"))
    folders = s.select("series_id", F.concat(F.lit(f"{base}/in/"), "series_id").alias("path"))

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pathlib import Path

        for b in batches:
            for p in b["path"]:
                Path(p).mkdir(parents=True, exist_ok=True)
            yield b

    laid = ws.save(folders.mapInPandas(lay, folders.schema), "laid")
    texts = s.where("s_suppkey % 2 = 0").select("series_id", F.lit("lung cancer with tumor").alias("title"), F.lit("").alias("summary"), F.lit("").alias("overall_design"))
    one, two = (ws.save(layout_folders(laid, texts, f"{base}/themed"), n) for n in ("one", "two"))
    total = layout_summary(one, "symlink").select(F.col("created").alias("total"))
    out = one.join(two.select("series_id", F.col("status").alias("again")), "series_id")
    return out.crossJoin(F.broadcast(total)).select("series_id", "domain", "organ", "status", "again", "total")  # one row


@query("""select 'CL:' || n_nationkey as id, case when n_nationkey % 2 = 0 then n_name || ' more' else n_name end as name, (select count(*) + count(*) filter (n_nationkey % 2 = 0) from nation) as kept from nation""")
def kept_term_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of terms are kept; when half of the terms change, only those are encoded again."""
    e = _engine(spark, "vectors")
    n = table(spark, sf_dir, "nation")
    none = F.array().cast("array<string>").alias("synonyms")
    terms = n.select(F.lit("CL").alias("onto"), _text("CL:", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"), none)
    changed = n.select(F.lit("CL").alias("onto"), _text("CL:", F.col("n_nationkey")).alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" more"))).otherwise(F.col("n_name")).alias("name"), none)
    e.term_vectors(terms).count()
    got = e.term_vectors(changed)
    kept = spark.read.option("recursiveFileLookup", True).parquet(e.config.path("ontology_vectors")).agg(F.count("*").alias("kept"))
    right = e.providers.encoder.column(changed, "name", "want").select("id", "name", "want")
    return got.join(right, "id").where("vec = want").crossJoin(F.broadcast(kept)).select("id", "name", "kept")  # one row


# ---- models


def _lengths(device: str):
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def _firsts(device: str):
    return lambda texts: [[float(ord(t[:1] or " ")), 2.0, 3.0] for t in texts]


def _gap(device: str):
    return lambda pairs: [float(len(q) - len(p)) for q, p in pairs]


def _registry() -> ModelRegistry:
    return ModelRegistry([ModelSpec("lengths", "encoder", _lengths, document_prefix="doc: ", unit=False), ModelSpec("firsts", "encoder", _firsts, unit=False), ModelSpec("gap", "reranker", _gap)])


@query("""select p_partkey, case when p_partkey % 2 = 0 then (length(p_name) + 5)::double else ascii(p_name)::double end as first, case when p_partkey % 2 = 0 then 2 else 3 end::bigint as dims, (length(p_type) - length(p_brand))::double as score from part""")
def registered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two encoders and a reranker chosen by a column, in one plan."""
    r = _registry()
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "lengths").otherwise("firsts").alias("model"), F.lit("gap").alias("judge"))
    out = r.scores(r.vectors(p, "p_name"), "p_type", "p_brand", model="judge", out="score")
    return out.select("p_partkey", F.col("vec")[0].cast("double").alias("first"), F.size("vec").cast("long").alias("dims"), "score")


@query("""select event_id, 'to ' || event_type || ' ' || event_id as response, 'm' || event_id % 3 as model, event_id % 100 as eval_tokens, case when event_id % 4 = 0 then 'timeout' else 'none' end as failure_class, sha1('to ' || event_type || ' ' || event_id) as hash from events""")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that come as JSON lines in pieces of any length, with broken lines between; what each call was is its envelope."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["event_id"], b["event_type"], strict=True):
                lines = [json.dumps({"message": {"content": x}}) for x in ("to ", t, " ", str(k))]
                end = {"done": True, "model": f"m{k % 3}", "eval_count": k % 100, "total_duration": 1000}
                body = "\n".join([*lines[:2], "{broken", *lines[2:], json.dumps(end | ({"error": "read timeout"} if k % 4 == 0 else {}))]).encode()
                step = 1 + k % 23
                s = TokenStream([body[i : i + step] for i in range(0, len(body), step)])
                assert len(list(s)) == 4
                rows.append({"event_id": k, **s.call})
            yield pd.DataFrame(rows)

    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").cast("string").alias("event_type")).mapInPandas(run, f"event_id long, {CALL}")
    out = envelope(calls.withColumn("model", F.concat("model", F.lit("#"), F.col("event_id").cast("string"))))
    parts = F.split("model", "#")
    return out.select(parts[1].cast("long").alias("event_id"), F.col("response_text").alias("response"), parts[0].alias("model"), F.col("eval_tokens").cast("long").alias("eval_tokens"), "failure_class", F.col("raw_output_sha1").alias("hash"))


class _Names:
    """A generator that answers many prompts at once: the last word of a title is its tissue; some prompts have no answer."""

    @staticmethod
    def many(prompts: list[str]) -> list[str]:
        title = lambda p: p.split("Title: ", 1)[1].split("\n", 1)[0]
        return ["no idea" if title(p).endswith("#1") else f'```json\n{{"tissues": ["{title(p).split()[-1]}"], "diseases": []}}\n```' for p in prompts]


@query("""select 'GSE' || p_partkey as gse_id, case when p_brand like '%#1' then '' else regexp_extract(p_name || ' ' || p_brand, '(\\S+)$', 1) end as tissue from part""")
def extracted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    studies = table(spark, sf_dir, "part").select(_text("GSE", F.col("p_partkey")).alias("gse_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.lit("s").alias("summary"))
    return extract_metadata(studies, _Names).select("gse_id", F.coalesce(F.get("tissues", F.lit(0)), F.lit("")).alias("tissue"))


@query("""with i as (select event_id % 5 as d, event_type, event_id % 2 = 0 as gold from events where event_id % 15 = 4), r as (select 'm' || m as model, d, avg(case when (m = 0) = gold then 1.0 else 0.0 end) as accuracy from i, (values (0), (1)) t(m) group by all)
select model, round(avg(round(accuracy, 4)), 4) as composite, count(*) as datasets from r group by model""")
def evaluated_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models on all yes-or-no items of events; the second is asked by a second run, which leaves the first one's results."""
    ws = Workspace(spark, "panel")
    items = _items(spark, sf_dir).where("evaluator = 'boolean'").select(_text("d", F.col("event_id") % 5).alias("dataset"), F.lit("c").alias("category"), "evaluator", "answer_field", "shift", "item_id", "item")
    of = lambda name: lambda prompt: "yes" if name == "m0" else "no"
    run_panel(spark, f"{ws.root}/results", items, of, ["m0"], most=1 << 30)
    got = run_panel(spark, f"{ws.root}/results", items, of, ["m0", "m1"], most=1 << 30)
    composites = category_composites(got, ["model", "category"])
    records = run_records(composites).select("model", F.explode("composites").alias("category", "composite"))
    return records.join(composites.select("model", "datasets"), "model").select("model", "composite", F.col("datasets").cast("long").alias("datasets"))


# ---- saved forms


@query("""select 'GSE' || c_custkey as series_id, c_name as title, c_custkey % 40 as n_samples, case when c_custkey % 2 = 0 then 'a.h5,b.csv' else '' end as files from customer""")
def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series saved by a search as lines, and by another tool as arrays, read again."""
    e = _engine(spark, "saved")
    k = F.col("c_custkey")
    files = F.when(k % 2 == 0, F.array(F.lit("a.h5"), F.lit("b.csv"))).otherwise(F.array().cast("array<string>"))
    c = table(spark, sf_dir, "customer").select(k, _text("GSE", k).alias("series_id"), F.col("c_name").alias("title"), (k % 40).alias("n_samples"), files.alias("supplementary_files"))
    c.where(k % 3 != 0).drop("c_custkey").write.json(e.config.path("found/kind=lines"))
    other = c.where(k % 3 == 0).withColumnRenamed("series_id", "gse_id")
    arrays = other.groupBy(F.expr("c_custkey div 300").alias("block")).agg(_text("[\n", F.array_join(F.collect_list(F.to_json(F.struct("gse_id", "title", "n_samples", "supplementary_files"))), ",\n"), "\n]").alias("value"))
    arrays.repartition("block").select("value").write.option("maxRecordsPerFile", 1).text(e.config.path("found/kind=arrays"))
    got = e.saved_series(e.config.path("found"))
    return got.select("series_id", "title", F.col("n_samples").cast("long").alias("n_samples"), F.array_join("supplementary_files", ",").alias("files"))


@query("""select 'GSE' || c_custkey as gse_id, c_custkey as kept, case when c_custkey % 2 = 0 then c_mktsegment || '>' || 'T:' || length(c_mktsegment) else '' end as mapped from customer""")
def rewritten_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies' documents with mappings put in; fields that no column is made of stay, former mappings go."""
    ws = Workspace(spark, "rewritten")
    k = F.col("c_custkey")
    text = _text('{"gse_id": "GSE', k, '", "own": {"deep": [', k, ']}, "ontology_mappings": {"old": []}}')
    table(spark, sf_dir, "customer").select(text.alias("value")).write.text(f"{ws.root}/studies")
    m = F.array(F.struct(F.lit(0).alias("pos"), F.col("c_mktsegment").alias("raw"), _text("T:", F.length("c_mktsegment")).alias("id"), F.lit("n").alias("onto_name"), F.lit("UBERON").alias("onto"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method")))
    mappings = table(spark, sf_dir, "customer").where(k % 2 == 0).select(_text("GSE", k).alias("gse_id"), F.lit("tissue").alias("category"), m.alias("mappings"))
    docs = with_mappings(study_documents(spark, f"{ws.root}/studies"), mappings)
    at = lambda path, kind: F.try_variant_get("doc", path, kind)
    one = F.concat_ws(">", at("$.ontology_mappings.tissue[0].raw_term", "string"), at("$.ontology_mappings.tissue[0].ontology_id", "string"))
    return docs.where(at("$.ontology_mappings.old", "variant").isNull()).select(at("$.gse_id", "string").alias("gse_id"), at("$.own.deep[0]", "long").alias("kept"), one.alias("mapped"))


@query("""select 'GSE' || c_custkey as series_id, 'GSE' || c_custkey || '  ' || case when c_custkey % 2 = 0 then 'CANCER' else '?' end || '  [' || case c_custkey % 3 when 0 then '?' when 1 then 'RNA' else 'RNA+ATAC' end || ']' || chr(10) || '    ' || left(c_name, 75) || chr(10) || '    Organism: ? | Type: ' || c_mktsegment || chr(10) || '    Formats:  none' as text from customer""")
def dataset_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kinds = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("rna"))).otherwise(F.array(F.lit("atac"), F.lit("rna")))
    d = table(spark, sf_dir, "customer").select(_text("GSE", k).alias("series_id"), F.when(k % 2 == 0, "cancer").otherwise("unknown").alias("domain"), kinds.alias("modalities"), F.col("c_name").alias("title"), F.lit("").alias("organism"), F.col("c_mktsegment").alias("series_type"), F.lit("none").alias("available_formats"))
    return dataset_lines(d)


@query("""with l as (select o_custkey, case when o_orderkey % 3 != 0 then '+ ' || rpad('f' || o_orderkey, 50, ' ') || ' [size unknown]' else '- ' || rpad('f' || o_orderkey, 50, ' ') || ' [HTTP 404]' end as line, o_orderkey % 3 != 0 as ok from orders)
select 'GSE' || o_custkey as series_id, 'GSE' || o_custkey || chr(10) || '    ' || string_agg(line, chr(10) || '    ' order by line) || chr(10) || '    ' || count(*) filter (ok) || '/' || count(*) || ' accessible | Total: 0 B' as text from l group by o_custkey""")
def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    links = table(spark, sf_dir, "orders").select(_text("GSE", F.col("o_custkey")).alias("series_id"), _text("http://x/f", k).alias("url"), F.when(k % 3 != 0, 200).otherwise(404).alias("status_code"), (k % 3 != 0).alias("accessible"), F.lit(None).cast("long").alias("size"), F.lit("").alias("error"))
    return link_lines(links)


@query("select p_brand as family, case when p_brand like '%#1' then 'json' else '' end as json_hint, 4096::bigint as context, 'a,b' as quirks from (select distinct p_brand from part)")
def family_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family's own settings over the defaults of all."""
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.when(F.col("p_brand").endswith("#1"), "json").alias("json_hint")).distinct()
    out = with_defaults(f, {"json_hint": "", "context": 4096, "quirks": ["a", "b"]})
    return out.select("family", "json_hint", F.col("context").cast("long").alias("context"), F.array_join("quirks", ",").alias("quirks"))


@query("select 'GSE' || s_suppkey as series_id, case when s_suppkey % 2 = 0 then 'first' else 'second' end as title from supplier")
def ingested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that land in two lots; the second run takes the new ones only, and a record that comes again doesn't replace the first."""
    ws = Workspace(spark, "ingested")
    k = F.col("s_suppkey")

    def land(rows: DataFrame, word: str) -> None:
        x = rows.select(_text("GSE", k, ".soft").alias("name"), _text("^SERIES = GSE", k, "\n!Series_title = ", word, "\n").alias("text"))
        folder = local_path(f"{ws.root}/landed")

        def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pathlib import Path

            Path(folder).mkdir(parents=True, exist_ok=True)
            for b in batches:
                for n, t in zip(b["name"], b["text"], strict=True):
                    (Path(folder) / f"{word}_{n}").write_text(t)
                yield b[["name"]]

        ws.save(x.repartition(64).mapInPandas(write, "name string"), word)  # small rows, but a file each

    s = table(spark, sf_dir, "supplier")
    out = [f"{ws.root}/{n}" for n in ("landed", "out", "mark")]
    land(s.where(k % 2 == 0), "first")
    ingest_series(spark, *out)
    land(s, "second")
    ingest_series(spark, *out)
    return spark.read.parquet(out[1]).select("series_id", "title")
