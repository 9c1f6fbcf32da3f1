"""Contexts, prompts and answers from ranked studies."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.lexicon import LIMITS
from quarry.functions.text import failure_class, joined, json_text, series_ids, truncate
from quarry.operators.ranking import budget_prefix
from quarry.plans.evaluate import answer_items
from quarry.providers import Providers


def _c(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def context_text(form: str = "structured", rank: str = "rank") -> Column:
    """One study as 'structured', 'minimal' or 'full' text, with its number."""
    head = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.coalesce("gse_id", F.lit("???")), F.lit(": "), _c("title"))
    plain = lambda n: joined(F.col(n))
    if form == "full":
        parts = [("Summary", _c("summary")), ("Organism", _c("organism")), ("Tissues", plain("tissues")), ("Diseases", plain("diseases")), ("Cell types", plain("cell_types"))]
        return F.concat(head, F.lit("\n"), *(x for n, v in parts for x in (F.lit(f"  {n}: "), v, F.lit("\n"))))
    if form == "minimal":
        return F.concat(head, F.lit(" | "), joined(F.col("tissues"), "N/A"), F.lit(" | "), joined(F.col("diseases"), "N/A"))
    return F.concat(head, F.lit("\n  Organism: "), _c("organism"), F.lit(" | Tissues: "), plain("tissues"), F.lit(" | Diseases: "), plain("diseases"), F.lit("\n"))


def detail_text() -> Column:
    """A search result as lines, with its scores."""
    rows = [("Organism", _c("organism")), ("Domain", _c("domain")), ("Samples", _c("n_samples"))]
    rows += [(n, joined(F.col(c), "N/A")) for n, c in (("Modalities", "modalities"), ("Tissues", "tissues"), ("Diseases", "diseases"), ("Cell types", "cell_types"), ("Treatments", "treatments"))]
    rows.append(("Submission", _c("submission_date")))
    lines = [F.concat(F.lit("### "), "gse_id", F.lit(": "), _c("title")), *(F.concat(F.lit(f"- {n}: "), v) for n, v in rows)]
    lines.append(F.when(_c("summary") != "", F.concat(F.lit("- Summary: "), truncate(F.col("summary"), LIMITS["summary"], "..."))))
    lines.append(F.when(_c("overall_design") != "", F.concat(F.lit("- Design: "), truncate(F.col("overall_design"), LIMITS["design"], "..."))))
    lines.append(F.format_string("- Retrieval score: %.3f / Rerank: %.3f", F.coalesce("dense_score", F.lit(0.0)), F.coalesce("rerank_score", F.lit(0.0))))
    return F.concat_ws("\n", *lines)


def joined_rows(rows: DataFrame, text: Column, order: str, separator: str, group: list[str] | None = None) -> DataFrame:
    """Texts of a result list in order, as one ``context``."""
    some = rows.select(*(group or []), F.struct(F.col(order).alias("o"), text.alias("t")).alias("x"))
    agg = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), separator).alias("context")
    return some.groupBy(*group).agg(agg) if group else some.agg(agg)


def field_chunks(studies: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(gse_id, chunk_no, chunk_type, text): header, summary, metadata and abstract; short summaries and abstracts leave."""
    key = F.coalesce("gse_id", F.lit("???"))
    some = lambda label, n: F.when(F.size(F.col(n)) > 0, F.concat(F.lit(f"{label}: "), joined(F.col(n))))
    header = F.concat(key, F.lit(": "), _c("title"), F.when(_c("organism") != "", F.concat(F.lit(" | Organism: "), "organism")).otherwise(""), F.when(F.size("modalities") > 0, F.concat(F.lit(" | Modalities: "), joined(F.col("modalities")))).otherwise(""))
    meta = F.concat_ws(" | ", some("Tissues", "tissues"), some("Diseases", "diseases"), some("Cell types", "cell_types"))
    long = lambda label, x: F.when(F.length(x) > 20, F.concat(key, F.lit(f" {label}: "), x))
    abstract = F.col("pubmed")["abstract"] if "pubmed" in studies.columns else F.lit(None).cast("string")
    texts = [("header", header), ("summary", long("summary", F.col("summary"))), ("metadata", F.when(meta != "", F.concat(key, F.lit(" metadata: "), meta))), ("abstract", long("abstract", abstract))]
    chunks = F.filter(F.array(*(F.struct(F.lit(i).alias("chunk_no"), F.lit(n).alias("chunk_type"), t.alias("text")) for i, (n, t) in enumerate(texts))), lambda c: c["text"].isNotNull())
    out = studies.select(key.alias("gse_id"), F.explode(chunks).alias("c")).select("gse_id", "c.*")
    return out.where(F.col("chunk_type").isin(*kinds)) if kinds else out


def within_budget(studies: DataFrame, budget: int = 2000, form: str = "structured", group: list[str] | None = None) -> DataFrame:
    """The first studies whose context texts fit a budget of tokens of four characters."""
    return budget_prefix(studies, F.length(context_text(form)), ["rank"], budget * 4, group)


def answer_prompt(query: str, parsed: dict[str, str], n: int, context: str) -> str:
    """Prompt with the query, its constraints, the datasets and what to do with them."""
    rows = "\n".join(f"- {name}: {parsed.get(key) or 'any'}" for name, key in (("Organism", "organism"), ("Tissue", "tissue"), ("Disease", "disease"), ("Cell type", "cell_type"), ("Assay", "assay")))
    steps = "Summarize the datasets that fit, each with its accession, key metadata and relevance. Say which can be integrated or compared. Cite the accession for every claim. End with coverage and gaps."
    return f"Query: {query}\n\nConstraints\n{rows}\n\nDatasets ({n})\n\n{context}\n\n{steps}\n"


def fallback_answer(results: DataFrame, query: str) -> Column | DataFrame:
    """Deterministic answer from the results alone."""
    line = lambda n, v: F.when(v != "", F.concat(F.lit(f"- **{n}**: "), v))
    samples = F.when(F.coalesce("n_samples", F.lit(0)) > 0, F.col("n_samples").cast("string")).otherwise("")
    score = F.when(F.coalesce("rerank_score", F.lit(0.0)) != 0, F.col("rerank_score")).otherwise(F.coalesce("dense_score", F.lit(0.0)))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), "gse_id", F.lit(" — "), _c("title")),
        F.concat(F.lit("- **Organism**: "), _c("organism")),
        line("Tissues", joined(F.col("tissues"))),
        line("Diseases", joined(F.col("diseases"))),
        line("Cell types", joined(F.col("cell_types"))),
        line("Samples", samples),
        F.concat(F.lit("- **Relevance score**: "), F.format_string("%.3f", score)),
        F.lit(""),
    )
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    body = joined_rows(results.withColumn("_n", n), block, "rank", "\n", ["_n"])
    found = body.select(F.concat(F.lit(f'## Results for: "{query}"\n\nFound **'), F.col("_n").cast("string"), F.lit(" datasets** matching your query.\n\n"), "context").alias("answer"))
    return found.groupBy().agg(F.coalesce(F.max("answer"), F.lit(f"No datasets found matching: {query}")).alias("answer"))


def result_stats(results: DataFrame) -> DataFrame:
    first = F.when(F.col("rank") == 1, F.col("dense_score")), F.when(F.col("rank") == 1, F.col("rerank_score"))
    return results.agg(F.count("*").alias("total_results"), F.coalesce(F.max(first[0]), F.lit(0.0)).alias("top_score"), F.coalesce(F.max(first[1]), F.lit(0.0)).alias("top_rerank_score"))


def call_models(calls: list[tuple[str, Callable[[str], str]]], prompt: str) -> dict:
    """A record of the first (name, call) that succeeds, or of the last failure; ``envelope`` takes it."""
    row = {"response": None, "fallback_used": False, "model": "", "eval_tokens": 0, "prompt_tokens": 0, "duration_ns": 0, "error": ""}
    for i, (name, call) in enumerate(calls):
        began = time.monotonic_ns()
        row |= {"model": name, "fallback_used": i > 0}
        try:
            return row | {"response": (call(prompt) or "").strip(), "duration_ns": time.monotonic_ns() - began, "error": ""}
        except Exception as e:  # any failure of a provider leads to the next one
            row["error"] = f"{type(e).__name__}: {e}"
    return row


CALL = "response string, fallback_used boolean, model string, eval_tokens int, prompt_tokens int, duration_ns long, error string"


def results_context(results: DataFrame, form: str = "", most: int | None = None) -> str:
    """The results as one text: with all details, or in a context form, and of the first ``most`` only."""
    rows = results if most is None else results.where(F.col("rank") <= most)
    return joined_rows(rows, context_text(form) if form else detail_text(), "rank", "\n" if form else "\n\n").first()[0] or ""


def generate(results: DataFrame, query: str, parsed: dict[str, str], providers: Providers | None = None, more: list | None = None, context: str | None = None, calls: list[tuple[str, Callable[[str], str]]] | None = None) -> dict:
    """Answer by the generator, else by the fallback generators, else from the results; with statistics and the envelope of the call.

    ``calls`` are (name, call) in order, in place of the provider's generator and ``more``; ``context`` stands for the results' details.
    """
    providers = providers or Providers()
    if "overall_design" not in results.columns:  # the index doesn't hold it
        results = results.withColumn("overall_design", F.lit(""))
    stats = result_stats(results).first().asDict()
    prompt = answer_prompt(query, parsed, stats["total_results"], results_context(results) if context is None else context)
    row = call_models(calls or [("", c) for c in (providers.generator.answer, *(more or []))], prompt)
    text = row["response"]
    if text is None:
        text = fallback_answer(results, query).first()[0]
    record = envelope(results.sparkSession.createDataFrame([row], CALL)).first().asDict()
    return {"query": query, "answer": text, "retrieval_stats": stats, "generation": record}


def envelope(calls: DataFrame) -> DataFrame:
    """Generation records: ``response, fallback_used, model, eval_tokens, prompt_tokens, duration_ns, error`` -> envelope."""
    text = F.coalesce("response", F.lit(""))
    failed = F.coalesce("error", F.lit("")) != ""
    return calls.select(
        text.alias("response_text"),
        F.when(text != "", F.sha1(text.cast("binary"))).otherwise("").alias("raw_output_sha1"),
        F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"),
        (F.btrim(text, F.lit(" \t\r\n")) == "").alias("empty_content"),
        F.when(failed, "not_attempted").when(json_text(text).isNotNull(), "ok").otherwise("no_json").alias("parse_status"),
        F.when(failed, failure_class(F.col("error"))).otherwise("none").alias("failure_class"),
        F.coalesce("error", F.lit("")).alias("error_message"),
        F.coalesce("model", F.lit("")).alias("model"),
        "eval_tokens",
        "prompt_tokens",
        F.round(F.coalesce("duration_ns", F.lit(0)) / 1_000_000, 1).alias("duration_ms"),
        json_text(text).alias("json"),
    )


def citations(text: Column) -> Column:
    return series_ids(text)


def parse_with(generate, query: str, fallback: dict[str, str]) -> dict[str, str]:
    """Constraints of a query from a generator's JSON; its failure gives ``fallback``, an answer without JSON free text only."""
    fields = ("organism", "tissue", "disease", "cell_type", "assay", "treatment")
    try:
        text = generate(f"Give the constraints of this query as JSON with the keys {', '.join(fields)} and free_text.\n\n{query}")
    except Exception:  # any failure of the provider
        return fallback
    data = json_object(text) or {}
    return {f: str(data.get(f) or "") for f in fields} | {"free_text": str(data.get("free_text") or query)}


def json_object(text: str) -> dict | None:
    """The JSON object in a text, on the driver; the same three steps as ``functions.text.json_text``."""
    import json
    import re

    def load(t: str | None) -> dict | None:
        try:
            found = json.loads(t) if t else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    fence = re.search(r"```(?:json)?\s*\n?(.*?)\n?\s*```", text, re.S)
    if fence and (found := load(fence[1].strip())) is not None:
        return found
    start = text.find("{")
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(text[start:])
    except ValueError:
        return load(text[start : text.rfind("}") + 1])
    return found if isinstance(found, dict) else None


def compress(results: DataFrame, query: str, generate, words: int = 500) -> str:
    """The results' contexts, summarized by a generator for the query."""
    context = joined_rows(results, context_text(), "rank", "\n").first()[0] or ""
    return generate(f"In at most {words} words, keep what matters for the query and all accessions.\n\nQuery: {query}\n\n{context}")


def refine_prompt(query: str, titles: list[str]) -> str:
    """Prompt for a more specific query, given the first titles found."""
    found = "\n".join(f"- {t}" for t in titles)
    return f"Query: {query}\n\nFirst results\n{found}\n\nWrite one more specific search query that finds further datasets. Answer with the query alone."


def extract_metadata(studies: DataFrame, generate, batch: int = 16) -> DataFrame:
    """(gse_id, tissues, diseases, cell_types) that a generator finds in title and summary; empty lists without an answer.

    A generator with ``many`` gets up to ``batch`` prompts at once. A call that fails is no answer.
    """
    lead = F.lit("Give tissues, diseases and cell_types of this study as JSON lists.\n\nTitle: ")
    prompt = F.concat(lead, F.coalesce("title", F.lit("")), F.lit("\nSummary: "), F.coalesce(F.substring("summary", 1, LIMITS["summary"]), F.lit("")))
    got = F.from_json(json_text(F.coalesce("response", F.lit(""))), "struct<tissues: array<string>, diseases: array<string>, cell_types: array<string>>")
    rows = answer_items(studies.select("gse_id", prompt.alias("prompt")), generate, batch).withColumn("_m", got)
    return rows.select("gse_id", *(F.coalesce(F.col("_m")[c], F.array().cast("array<string>")).alias(c) for c in ("tissues", "diseases", "cell_types")))
