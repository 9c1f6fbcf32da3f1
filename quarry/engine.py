"""The engine: landed files in, studies, index, answers, manifests and matrices out. Every step is one lazy plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions.text import joined, nullif_empty
from quarry.operators.datasets import apply_filters, copies_needed, dataset_flags, download_order, downloadable
from quarry.operators.lookup import build_lookup, normalize_terms
from quarry.operators.matrix import quality_filter
from quarry.operators.rules import classify_files, domain_score, joined_text, modalities_of_text, parse_query, search_expression
from quarry.plans.acquire import Fetcher, download_ranged
from quarry.plans.answer import answer_prompt, compress, extract_metadata, fallback_answer, generate, parse_with, refine_prompt, results_context
from quarry.plans.convert import convert_folder, local_path, totals_by_series
from quarry.plans.enrich import enrich, study_mappings
from quarry.plans.evaluate import run_panel
from quarry.plans.index import encode, index_info, payload, write_index
from quarry.plans.models import Router
from quarry.plans.postings import Postings, write_postings
from quarry.plans.remote import Archive, fetch_records, land_search, land_summaries, watch_series
from quarry.plans.reports import layout_folders, layout_summary, manifest_files, organ_gaps, series_status, write_manifests, write_summary, write_theme_layout
from quarry.plans.retrieve import RetrievalSpec, multi_step, retrieve_many, search
from quarry.plans.vector_index import VectorIndex, write_cells
from quarry.providers import HttpGenerator, Providers, encoder_name
from quarry.runtime import Workspace, exists, ship
from quarry.sources.matrices import read_any, read_triplet, scan_folder
from quarry.sources.obo import entry_text, parse_terms, read_obo, synonyms_of
from quarry.sources.records import listed_files, read_articles, read_summaries, series_hits, studies_of, study_by_id, study_documents, with_mappings
from quarry.sources.soft import parse_samples, parse_series, read_texts, select_accessions, supplementary_urls
from quarry.versions import VersionedTable


class Engine:
    def __init__(self, spark: SparkSession, config: Config | None = None, providers: Providers | None = None):
        ship(spark)
        self.spark, self.config, self.providers = spark, config or Config(), providers or Providers()
        self.router = Router(set(self.providers.registered), self.config.default_model)

    # ---- acquisition

    def search_series(self, summaries: str, listings: DataFrame | None = None, min_samples: int | None = None) -> DataFrame:
        """Series of landed search summaries with their listed files, if enough samples."""
        hits = series_hits(read_summaries(self.spark, summaries)).where(F.col("n_samples") >= (self.config.min_samples if min_samples is None else min_samples))
        if listings is None:
            return hits.withColumn("supplementary_files", F.array().cast("array<string>"))
        files = listed_files(listings).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("x"))
        found = hits.join(files, "series_id", "left")
        return found.withColumn("supplementary_files", F.coalesce(F.transform("x", lambda x: x["url"]), F.array().cast("array<string>"))).drop("x")

    def find_series(self, expression: str, target: str, organism: str | None = None, kind: str | None = None, limit: int | None = None, start: int = 0, min_samples: int | None = None, archive: Archive | None = None) -> DataFrame:
        """Series of a search of the archive, whose answer and summaries are landed below ``target``."""
        row = self.spark.range(1).select(search_expression(*(F.lit(x).cast("string") for x in (expression, organism, kind))).alias("q")).first()
        found = land_search(self.spark, row.q, f"{target}/search", limit or self.config.max_results, start, archive)
        lost = land_summaries(found.select(F.explode("ids").alias("id")), f"{target}/summaries", archive)
        lost.write.mode("overwrite").json(f"{target}/failed")
        return self.search_series(f"{target}/summaries", min_samples=min_samples)

    def lookup(self, accessions: DataFrame, archive: Archive | None = None) -> tuple[DataFrame, DataFrame]:
        """(series, lost) of accessions (id): those that are series are fetched as records and read; lost have no record, with the error."""
        ws = Workspace(self.spark, "lookup")
        wanted = ws.save(select_accessions(accessions), "wanted")
        got = ws.save(fetch_records(wanted, archive), "records")
        return parse_series(got.where("error = ''").select("series_id", "text")), got.where("error != ''").select("series_id", "error")

    def watch(self, expression: str, archive: Archive | None = None, **options: str) -> DataFrame:
        """All series that runs of this search have found; this run asks only for what is new."""
        out = self.config.path("watched")
        watch_series(self.spark, expression, out, f"{out}-checkpoint", archive, **options)
        return self.spark.read.parquet(out)

    def download(self, files: DataFrame, fetcher: Fetcher, target: str) -> DataFrame:
        """(series_id, status) after fetching the planned files in parts; what came of each file is in the table ``downloads``.

        Whoever reads ``download_progress`` meanwhile sees which parts are there.
        """
        planned = self.download_plan(downloadable(files) if "format_type" in files.columns else files)
        got = download_ranged(planned.select("series_id", "url"), fetcher, target, self.config.path("download_progress"))
        got.write.mode("overwrite").json(self.config.path("downloads"))
        done = self.spark.read.schema(got.schema).json(self.config.path("downloads"))
        out = series_status(done)
        out.write.mode("overwrite").json(self.config.path("download_status"))
        return out

    def classify(self, series: DataFrame, samples: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(datasets, files): files classified, sample files probed where a series has only archives, domain and modalities."""
        files = series.select("series_id", F.posexplode("supplementary_files").alias("pos", "url"))
        own = classify_files(files).withColumn("probed", F.lit(False))
        if samples is not None:
            flags = dataset_flags(own)
            opaque = flags.where("not is_convertible and has_tar").select("series_id")
            probed = classify_files(supplementary_urls(samples).join(opaque, "series_id", "left_semi")).withColumn("probed", F.lit(True))
            own = own.unionByName(probed)
        flags = dataset_flags(own, probed="probed")
        text = joined_text(F.col("title"), F.col("summary"), F.coalesce(F.col("overall_design"), F.lit("")) if "overall_design" in series.columns else F.lit(""))
        meta = series.select("series_id", "title", "organism", "series_type", modalities_of_text(text, F.col("series_type")).alias("_text"), domain_score(text).alias("_d"))
        out = meta.join(flags.withColumnRenamed("modalities", "_files"), "series_id", "left")
        none = F.array().cast("array<string>")
        out = out.withColumn("modalities", F.array_sort(F.array_union(F.coalesce("_text", none), F.coalesce("_files", none))))
        out = out.withColumns({"domain": F.col("_d.domain"), "domain_keywords": F.col("_d.keywords"), "is_convertible": F.coalesce("is_convertible", F.lit(False)), "available_formats": F.coalesce("available_formats", F.lit("none"))})
        return out.drop("_text", "_files", "_d"), own

    def select(self, datasets: DataFrame, files: DataFrame, **filters) -> tuple[DataFrame, DataFrame]:
        return apply_filters(datasets, files, **filters)

    def download_plan(self, files: DataFrame) -> DataFrame:
        return download_order(files, max_gb=self.config.max_file_gb, size="size_bytes" if "size_bytes" in files.columns else None)

    def write_manifests(self, series: DataFrame, local: DataFrame, remote: DataFrame | None = None) -> str:
        path = self.config.path("manifests")
        write_manifests(series, manifest_files(local, remote), path)
        return path

    def organize(self, files: DataFrame, series: DataFrame) -> str:
        path = self.config.path("themes")
        write_theme_layout(files, series, path)
        return path

    def lay_out(self, folder: str, series: DataFrame | None = None, mode: str = "symlink") -> DataFrame:
        """Series folders below ``folder`` placed by domain and organ below ``themed``, and a summary beside it; existing targets stay."""
        root = local_path(self.config.path("themed"))
        found = scan_folder(self.spark, folder).select(F.regexp_extract("path", r"(?i)^(?:file:)?(.*?/(GSE\d+)[^/]*)/", 1).alias("path"), F.upper(F.regexp_extract("path", r"(?i)/(GSE\d+)[^/]*/", 1)).alias("series_id"))
        ws = Workspace(self.spark, "layout")
        placed = ws.save(layout_folders(found.where("series_id != ''").distinct(), series, root, mode), "placed")
        write_summary(layout_summary(placed, mode), self.config.path("theme_summary"))
        return placed

    def saved_series(self, path: str) -> DataFrame:
        """Series of a saved search, of JSON lines or of one array, for another scan."""
        doc = study_documents(self.spark, path)
        field = lambda n, t="string": F.try_variant_get("doc", f"$.{n}", t)
        texts = ("title", "summary", "overall_design", "organism", "platform", "series_type", "submission_date", "ftp_link")
        lists = ("pubmed_ids", "supplementary_files")
        named = [F.coalesce(field(c), F.lit("")).alias(c) for c in texts] + [F.coalesce(field(c, "array<string>"), F.array().cast("array<string>")).alias(c) for c in lists]
        return doc.select(F.coalesce(field("series_id"), field("gse_id")).alias("series_id"), *named, F.coalesce(field("n_samples", "int"), F.lit(0)).alias("n_samples")).where("series_id is not null")

    def gaps(self, manifests: DataFrame, candidates: DataFrame, files: DataFrame, formats: list[str], **options) -> DataFrame:
        return organ_gaps(manifests, candidates, files, formats, **options)

    # ---- matrices

    def convert(self, folder: str, qc: bool = False) -> DataFrame:
        """Entries of all matrix files below a folder, written by series and sample, and a summary beside them.

        A series' samples lie in one table, so a merged matrix is a read of the series' folder. Files that give nothing are
        in the table ``conversions`` with their errors. Quality limits hold for each file alone.
        """
        made, results = convert_folder(self.spark, folder)
        c = self.config
        out = quality_filter(made, c.qc_min_genes, c.qc_min_cells, c.qc_max_mito_percent, within=["source"]) if qc else made
        path = self.config.path("matrices")
        out.write.mode("overwrite").partitionBy("series_id", "sample").parquet(path)
        results.write.mode("overwrite").json(self.config.path("conversions"))
        write_summary(totals_by_series(results), self.config.path("conversion_summary"))
        return self.spark.read.schema(made.schema).parquet(path)

    def place_matrices(self, folder: str, series: DataFrame | None = None, qc: bool = False, meta_only: bool = False) -> DataFrame:
        """(series_id, entries) of series folders whose matrix is new or has changed, after conversion; manifests are filled in.

        The matrix of a series stands in ``canonical`` by series. ``series`` gives the manifests' texts; without it they are empty.
        """
        local = scan_folder(self.spark, folder).withColumn("series_id", F.upper(F.regexp_extract("path", r"(?i)/(GSE\d+)[^/]*/", 1))).where("series_id != ''")
        local = local.select("series_id", "name", F.col("length").alias("size_bytes"))
        if series is None:
            none = F.lit("")
            series = local.select("series_id").distinct().select("series_id", *(none.alias(c) for c in ("title", "summary", "overall_design", "organism", "series_type")))
        self.write_manifests(series, local)
        count = F.count("*").alias("size_bytes")
        empty = self.spark.createDataFrame([], "series_id string, size_bytes long")
        if meta_only:
            return empty.withColumnRenamed("size_bytes", "entries")
        made, canonical = self.convert(folder, qc), self.config.path("canonical")
        old = self.spark.read.schema(made.schema).parquet(canonical).groupBy("series_id").agg(count) if exists(self.spark, canonical) else empty
        chosen = made.where("series_id != ''").groupBy("series_id").agg(count).withColumn("path", F.lit(self.config.path("matrices")))
        ws = Workspace(self.spark, "canonical")
        due = ws.save(copies_needed(chosen, old).select("series_id", F.col("size_bytes").alias("entries")), "due")
        writer = made.join(due, "series_id", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("series_id").parquet(canonical)
        return due

    def read_matrix(self, path: str, kind: str, barcodes: str | None = None, features: str | None = None) -> DataFrame:
        """(cell, gene, value) of one file, or of a triplet with its barcodes and features."""
        return read_triplet(self.spark, path, barcodes, features) if barcodes and features else read_any(self.spark, path, kind)

    # ---- studies

    def enrich(self, series: str, samples: str, articles: str | None = None) -> DataFrame:
        s = parse_series(read_texts(self.spark, series))
        return enrich(s, parse_samples(read_texts(self.spark, samples)), read_articles(self.spark, articles) if articles else None)

    def study_documents(self) -> DataFrame:
        """(doc): the current version of the rewritten studies, and landed ones that it doesn't hold."""
        landed, versions = self.config.path("studies"), self._versions("studies_mapped")
        if versions.current() is None:
            return study_documents(self.spark, landed)
        kept, gse = study_documents(self.spark, versions.path()), F.try_variant_get("doc", "$.gse_id", "string").alias("gse_id")
        if not exists(self.spark, landed):
            return kept
        new = study_documents(self.spark, landed).withColumn("gse_id", gse).join(kept.select(gse), "gse_id", "left_anti")
        return kept.unionByName(new.select("doc"))

    def studies(self) -> DataFrame:
        return studies_of(self.study_documents())

    def map_studies(self, ontology: str) -> DataFrame:
        """Rewrite the studies with their ontology mappings as a new version, which readers see when it is complete; returns the mappings."""
        docs = self.study_documents()
        ws = Workspace(self.spark, "mappings")
        found = ws.save(self.normalize(studies_of(docs), ontology), "found")
        text = with_mappings(docs, found).select(F.to_json("doc").alias("value"))
        self._versions("studies_mapped").write(lambda path: text.write.text(path), f"mapped to {ontology}")
        return found

    def _versions(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.config.path(name))

    def normalize(self, studies: DataFrame, ontology: str) -> DataFrame:
        """Ontology mappings of the studies' terms: exact, else nearest by the encoder."""
        terms = parse_terms(read_obo(self.spark, ontology))
        enc = self.providers.encoder
        vectors = self.term_vectors(terms)
        fields = F.array(*(F.struct(F.lit(c).alias("category"), F.col(n).alias("t")) for c, n in (("tissue", "tissues"), ("disease", "diseases"), ("cell_type", "cell_types"))))
        wanted = studies.select(F.explode(fields).alias("f")).select("f.category", F.explode("f.t").alias("raw"))
        matched = normalize_terms(wanted, build_lookup(terms, synonyms_of(terms)), terms, vectors, lambda d: enc.column(d, "raw"), self.config.ontology_threshold, self._nearest_terms(vectors))
        return study_mappings(studies, matched)

    def _nearest_terms(self, vectors: DataFrame):
        """A search for terms' nearest vectors of one ontology, through cells of all vectors: exact, and only cells that may hold a match are compared."""
        ws = Workspace(self.spark, "term-cells")
        write_cells(vectors, ws.root, "id", "vec", keep=["onto"])
        cells = VectorIndex(self.spark, ws.root, "id", "vec")

        def nearest(asked: DataFrame, threshold: float) -> DataFrame:
            query = F.to_json(F.struct("onto", "raw"))
            got = cells.matches(asked.withColumn("query_id", query), threshold, ["onto"])
            parts = F.from_json("query_id", "onto string, raw string")
            return got.withColumn("_p", parts).select("_p.onto", "_p.raw", "id", "score")

        return nearest

    def term_vectors(self, terms: DataFrame) -> DataFrame:
        """(onto, id, vec) of the terms: kept in a table by encoder, where only new or changed terms are encoded."""
        enc = self.providers.encoder
        path = f"{self.config.path('ontology_vectors')}/{encoder_name(enc)}"
        entries = terms.select("onto", "id", entry_text(F.col("name"), F.col("synonyms")).alias("entry"))
        old = self.spark.read.parquet(path) if exists(self.spark, path) else None
        new = entries if old is None else entries.join(old.select("onto", "id", "entry"), ["onto", "id", "entry"], "left_anti")
        ws = Workspace(self.spark, "vectors")
        made = ws.save(enc.column(new, "entry"), "new")
        if not made.isEmpty():
            made.write.mode("append").parquet(path)
        return self.spark.read.schema(made.schema).parquet(path).join(entries, ["onto", "id", "entry"], "left_semi").dropDuplicates(["onto", "id"]).drop("entry") if exists(self.spark, path) else made.drop("entry")

    def index(self, studies: DataFrame) -> str:
        """Index all studies anew; readers see it when it is complete. Returns the version's folder."""
        return self._write_index(encode(payload(studies), self.providers), "all studies")

    def reindex(self, studies: DataFrame) -> DataFrame:
        """The index with these studies added or in place of those with their ids, as a new version."""
        old = self._index_rows()
        new = encode(payload(studies), self.providers)
        kept = old.join(new.select("gse_id"), "gse_id", "left_anti").unionByName(new.select(old.columns))
        self._write_index(kept, "some studies")
        return self._index_rows()

    def _write_index(self, rows: DataFrame, note: str) -> str:
        def make(path: str) -> None:
            write_index(rows, f"{path}/rows")
            kept = self.spark.read.parquet(f"{path}/rows")
            write_postings(kept, f"{path}/postings")
            write_cells(kept, f"{path}/vectors")

        versions = self._versions("index")
        return f"{versions.root}/{versions.write(make, note).folder}"

    def _index_rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self._versions('index').path()}/rows")

    # ---- questions

    def _model(self, task: str, key: str = "") -> tuple[str, HttpGenerator] | None:
        """(name, generator) of a task's model, or of a named one that is registered; None without models."""
        if self.providers.models is None:
            return None
        router = self.router
        name = key if key in router.registered else router.default if key else router.model(task)
        return name, self.providers.models(name)

    def _tier(self, name: str = "") -> dict:
        """Settings of a tier, of the configured one if none is named; empty without any."""
        name = name or self.config.tier
        return self.router.tier(name) if name else {}

    def parse(self, query: str, tier: str = "") -> dict[str, str]:
        """Constraints of a query: by the tier's model where there are models, else by rules."""
        plain = self.spark.range(1).select(parse_query(F.lit(query)).alias("p")).select("p.*").first().asDict()
        model = self._model("query_parsing", self._tier(tier).get("parse_model", ""))
        return parse_with(model[1].answer, query, plain) if model else plain

    def retrieve(self, query: str, filters: dict[str, str] | None = None, tier: str = "", steps: int = 1, parsed: dict[str, str] | None = None) -> DataFrame:
        """Ranked studies. With two steps a model rewrites the query from the first titles, and both results are fused."""
        parsed = (self.parse(query, tier) if parsed is None else parsed) | (filters or {})
        spec = RetrievalSpec(self._tier(tier).get("strategy", self.config.strategy), self.config.top_k, self.config.rerank_k)
        at = self._versions("index").path()
        index, held = self.spark.read.parquet(f"{at}/rows"), Postings(self.spark, f"{at}/postings")
        model = self._model("fast_utility") if steps > 1 else None
        if model is None:
            return search(index, query, parsed, spec, self.providers, held)
        refine = lambda q, titles: model[1].answer(refine_prompt(q, titles))
        where = {"organism": parsed["organism"]} if parsed.get("organism") else None
        return multi_step(index, parsed.get("free_text") or query, spec, refine, where, self.providers)

    def retrieve_many(self, queries: DataFrame) -> DataFrame:
        """Ranked keys and scores of a table of queries (query_id, query), in one plan; each is filtered by the organism that it names."""
        parsed = queries.withColumn("_p", parse_query(F.col("query"))).select("query_id", F.coalesce(nullif_empty(F.col("_p.free_text")), F.col("query")).alias("query"), nullif_empty(F.col("_p.organism")).alias("organism"))
        asked = self.providers.encoder.column(parsed, "query")
        at = self._versions("index").path()
        spec = RetrievalSpec(self.config.strategy, self.config.top_k, self.config.rerank_k)
        return retrieve_many(self.spark.read.parquet(f"{at}/rows"), asked, spec, ["organism"], self.providers, postings=Postings(self.spark, f"{at}/postings"))

    def similar(self, queries: DataFrame, k: int, cells: int | None = None) -> DataFrame:
        """(query_id, gse_id, score, rank) of the studies whose vectors are nearest to (query_id, vec), exact or from some cells."""
        return VectorIndex(self.spark, f"{self._versions('index').path()}/vectors").search(queries, k, cells=cells)

    def _asked(self, query: str, tier: str, steps: int, compressed: bool) -> tuple[DataFrame, dict[str, str], str | None]:
        """(results as a saved table, constraints, context): the context is the tier's form, or a model's summary; None for all details."""
        parsed = self.parse(query, tier)
        results = Workspace(self.spark, "answer").save(self.retrieve(query, tier=tier, steps=steps, parsed=parsed).drop("vec"), "results")
        t = self._tier(tier)
        model = self._model("fast_utility") if compressed else None
        if model:
            try:
                return results, parsed, compress(results, query, model[1].answer)
            except Exception:  # without a summary the results speak for themselves
                pass
        return results, parsed, results_context(results, t["context_format"], t["context_k"]) if t else None

    def _answerers(self, tier: str) -> list[tuple[str, HttpGenerator]]:
        """The tier's or the task's model and the default one; the provider's generator without models."""
        first = self._model("answer_generation", self._tier(tier).get("answer_model", ""))
        if first is None:
            return [("", self.providers.generator)]
        return list({name: (name, g) for name, g in (first, self._model("", self.config.default_model))}.values())

    def answer(self, query: str, tier: str = "", steps: int = 1, compressed: bool = False) -> dict:
        results, parsed, context = self._asked(query, tier, steps, compressed)
        calls = [(name, g.answer) for name, g in self._answerers(tier)]
        return generate(results, query, parsed, self.providers, context=context, calls=calls)

    def stream(self, query: str, tier: str = "", steps: int = 1, compressed: bool = False) -> Iterator[str]:
        """The answer piece by piece; where the model fails, what the results say follows."""
        results, parsed, context = self._asked(query, tier, steps, compressed)
        if "overall_design" not in results.columns:
            results = results.withColumn("overall_design", F.lit(""))
        n = results.count()
        prompt = answer_prompt(query, parsed, n, results_context(results) if context is None else context)
        try:
            yield from self._answerers(tier)[0][1].stream(prompt)
        except Exception:  # any failure of the provider
            yield fallback_answer(results, query).first()[0]

    def extract(self, studies: DataFrame) -> DataFrame:
        """(gse_id, tissues, diseases, cell_types) that the task's model finds in the studies' texts."""
        model = self._model("metadata_extraction")
        return extract_metadata(studies, model[1].answer if model else self.providers.generator.answer)

    def evaluate(self, items: DataFrame, panel: list[str] | None = None, most: int = 200) -> DataFrame:
        """Results of a panel of models on evaluation items; goes on where an earlier run stopped."""
        if self.providers.models is None:
            raise ValueError("an evaluation needs models")
        models = self.providers.models
        return run_panel(self.spark, self.config.path("evaluation"), items, lambda m: models(m).answer, panel, set(self.providers.registered), most)

    def stats(self) -> DataFrame:
        return index_info(self._index_rows())

    def detail(self, gse_id: str) -> DataFrame:
        found = study_by_id(self._index_rows(), gse_id)
        return found.select("gse_id", "title", "organism", "domain", joined(F.col("tissues"), "N/A").alias("tissues"), joined(F.col("diseases"), "N/A").alias("diseases"), F.substring("summary", 1, 1000).alias("summary"))
