"""Command line: studies and questions, acquisition and reports, matrices, and queries of the catalogue.

Tables given to commands are JSON lines: series (series_id, title, summary, overall_design, organism, series_type,
supplementary_files), files (series_id, pos, url) and local files (series_id, name, size_bytes).
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import load_config, log_file
from quarry.engine import Engine
from quarry.operators.datasets import bucket_histogram, filter_files, selected
from quarry.operators.rules import classify_files
from quarry.plans.acquire import Fetcher, FolderFetcher, HttpFetcher, verify_links
from quarry.plans.evaluate import read_items
from quarry.plans.reports import dataset_lines, link_lines, link_report
from quarry.providers import HttpGenerator, Providers


def _filters(p: argparse.ArgumentParser) -> None:
    """Flags that all commands on series share."""
    for flag in ("--domain", "--modality", "--organism"):
        p.add_argument(flag)
    p.add_argument("--format", action="append", default=[])
    p.add_argument("--require-format", action="store_true")
    p.add_argument("--limit", type=int, help="most series to show or take, by accession")
    p.add_argument("--save", help="folder for the result as JSON lines")


def _remote(p: argparse.ArgumentParser) -> None:
    p.add_argument("--folder", help="where files stand instead of behind their urls")
    p.add_argument("--delay", type=float, default=0.0, help="seconds before each request")


def _chosen(args: argparse.Namespace) -> dict:
    return {"domain": args.domain, "modality": args.modality, "formats": args.format, "organism": args.organism, "require_format": args.require_format}


def _fetcher(args: argparse.Namespace) -> Fetcher:
    return FolderFetcher(args.folder) if args.folder else HttpFetcher(delay=args.delay)


def _first(series: DataFrame, limit: int | None) -> DataFrame:
    """The first series by accession, if there is a limit, which is the feature here."""
    return series if limit is None else series.orderBy("series_id").limit(limit)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Dataset discovery on Spark.")
    p.add_argument("--root", help="folder of all tables")
    p.add_argument("--log", help="folder for a log file")
    p.add_argument("--models", help="address of a chat service with language models")
    p.add_argument("--registered", help="names of its models, joined by commas")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("enrich", help="studies from landed series, samples and articles")
    one.add_argument("series")
    one.add_argument("samples")
    one.add_argument("--articles")
    one = sub.add_parser("ontology", help="map the terms of the studies to ontologies")
    one.add_argument("folder")
    sub.add_parser("embed", help="encode and index the studies")
    for name in ("retrieve", "answer"):
        one = sub.add_parser(name)
        one.add_argument("query", nargs="+")
        one.add_argument("--tier", default="", choices=["", "quality", "fast", "balanced"])
        one.add_argument("--steps", type=int, default=1, help="2 lets a model rewrite the query and asks again")
    one.add_argument("--compress", action="store_true", help="let a model summarize the results first")
    one.add_argument("--stream", action="store_true", help="print the answer as it comes")
    one = sub.add_parser("extract", help="terms that a model finds in the studies' texts")
    one.add_argument("--save", help="folder for the result as JSON lines")
    one = sub.add_parser("evaluate", help="run a panel of models on registered datasets, or go on with it")
    one.add_argument("registry", help="JSON lines: dataset, category, evaluator, answer_field, shift")
    one.add_argument("folder", help="datasets as JSON lines")
    one.add_argument("--models-of", nargs="+", dest="panel", help="these instead of the public panel")
    one.add_argument("--max-samples", type=int, default=200)
    one = sub.add_parser("lookup", help="fetch and read the records of accessions")
    one.add_argument("accessions", nargs="+")
    one.add_argument("--save", help="folder for the result as JSON lines")
    one = sub.add_parser("watch", help="series of a search that are new since the last time")
    one.add_argument("expression", nargs="+")
    sub.add_parser("chat", help="questions until /quit; /stats, /detail ID, /help")
    one = sub.add_parser("search", help="series of landed search summaries")
    one.add_argument("summaries")
    one.add_argument("--min-samples", type=int)
    one.add_argument("--save", help="folder for the result as JSON lines")
    one = sub.add_parser("find", help="search the archive, land its answer and summaries, and show the series")
    one.add_argument("expression", nargs="+")
    one.add_argument("--target", required=True, help="folder for what is landed")
    for flag in ("--organism", "--dataset-type", "--save"):
        one.add_argument(flag)
    one.add_argument("--max-results", type=int)
    one.add_argument("--start", type=int, default=0)
    one.add_argument("--min-samples", type=int)
    one = sub.add_parser("scan", help="formats, modality and domain of a series file list (JSON)")
    one.add_argument("series")
    _filters(one)
    one.add_argument("--require-convertible", action="store_true")
    one.add_argument("--show-files", action="store_true", help="how many files of each kind the series have")
    one.add_argument("--text", action="store_true", help="lines for a reader instead of JSON")
    one = sub.add_parser("verify", help="probe the links of a file list")
    one.add_argument("files")
    one.add_argument("--text", action="store_true", help="lines for a reader instead of JSON")
    _remote(one)
    one = sub.add_parser("download", help="fetch the chosen files of each series")
    one.add_argument("files")
    _remote(one)
    one.add_argument("--target", required=True)
    _filters(one)
    one.add_argument("--series", help="series table that domain and organism are taken from")
    one = sub.add_parser("manifest", help="write manifests of local files")
    one.add_argument("series")
    one.add_argument("files")
    one = sub.add_parser("organize", help="lay files out by domain and organ")
    one.add_argument("series")
    one.add_argument("files")
    one = sub.add_parser("layout", help="place series folders by domain and organ")
    one.add_argument("folder")
    one.add_argument("--series", help="series table with the texts")
    one.add_argument("--mode", default="symlink", choices=["symlink", "copy", "move"])
    one = sub.add_parser("gap", help="organs that no manifest covers, with candidates")
    one.add_argument("manifests")
    one.add_argument("candidates")
    _filters(one)
    one.add_argument("--download-top", type=int, default=0, help="fetch the files of this many first candidates an organ")
    one.add_argument("--target", help="folder for them")
    _remote(one)
    one = sub.add_parser("run", help="scan, select, download and convert")
    one.add_argument("series")
    _remote(one)
    one.add_argument("--target", required=True)
    _filters(one)
    one.add_argument("--qc", action="store_true")
    one = sub.add_parser("convert", help="matrices below a folder")
    one.add_argument("folder")
    one.add_argument("--qc", action="store_true")
    one = sub.add_parser("normalize", help="convert series folders, place each one's matrix, fill in manifests")
    one.add_argument("folder")
    one.add_argument("--series", help="series table for the manifests")
    one.add_argument("--qc", action="store_true")
    one.add_argument("--meta-only", action="store_true")
    one = sub.add_parser("query", help="a query of the catalogue over a folder of tables")
    one.add_argument("name")
    one.add_argument("folder")
    return p


def show(df: DataFrame, n: int = 20) -> None:
    for r in df.limit(n).toJSON().toLocalIterator():
        print(r)


def report(df: DataFrame, save: str | None) -> None:
    """Show a result; with a folder, write all of it there first."""
    if save:
        df.write.mode("overwrite").json(save)
        df = df.sparkSession.read.schema(df.schema).json(save)
    show(df)


def show_lines(df: DataFrame, n: int = 20) -> None:
    """Texts of (series_id, text) in order of accession."""
    for r in df.orderBy("series_id").limit(n).toLocalIterator():
        print(r.text)


def chat(engine: Engine, lines=sys.stdin) -> None:
    for line in lines:
        text = line.strip()
        if text in ("/quit", "/exit"):
            return
        if text == "/help":
            print("/stats, /detail ID, /quit, or a question")
        elif text == "/stats":
            show(engine.stats())
        elif text.startswith("/detail"):
            show(engine.detail(text.removeprefix("/detail").strip()))
        elif text:
            print(engine.answer(text)["answer"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    config = load_config()
    if args.root:
        config = replace(config, root=args.root)
    spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
    if args.log:
        log_file(args.log)
    providers = None
    if args.models:
        providers = Providers(models=partial(HttpGenerator, args.models), registered=frozenset((args.registered or config.default_model).split(",")))
    engine = Engine(spark, config, providers)
    if args.command == "enrich":
        engine.enrich(args.series, args.samples, args.articles).write.mode("append").json(config.path("studies"))
    elif args.command == "ontology":
        engine.map_studies(args.folder).write.mode("overwrite").json(config.path("mappings"))
    elif args.command == "embed":
        print(engine.index(engine.studies()))
    elif args.command == "retrieve":
        show(engine.retrieve(" ".join(args.query), tier=args.tier, steps=args.steps).orderBy("rank").drop("vec"))
    elif args.command == "answer":
        how = (" ".join(args.query), args.tier, args.steps, args.compress)
        if args.stream:
            for piece in engine.stream(*how):
                print(piece, end="", flush=True)
            print()
        else:
            print(json.dumps(engine.answer(*how), ensure_ascii=False))
    elif args.command == "extract":
        report(engine.extract(engine.studies()), args.save)
    elif args.command == "evaluate":
        kinds = "dataset string, category string, evaluator string, answer_field string, shift int"
        items = read_items(spark, spark.read.schema(kinds).json(args.registry), args.folder)
        show(engine.evaluate(items, args.panel, args.max_samples), 1000)
    elif args.command == "lookup":
        series, lost = engine.lookup(spark.createDataFrame([(a,) for a in args.accessions], "id string"))
        report(series, args.save)
        show(lost)
    elif args.command == "watch":
        show(engine.watch(" ".join(args.expression)))
    elif args.command == "chat":
        chat(engine)
    elif args.command == "search":
        report(engine.search_series(args.summaries, min_samples=args.min_samples), args.save)
    elif args.command == "find":
        report(engine.find_series(" ".join(args.expression), args.target, args.organism, args.dataset_type, args.max_results, args.start, args.min_samples), args.save)
    elif args.command == "scan":
        data, files = engine.classify(_first(engine.saved_series(args.series), args.limit))
        chosen, kept = engine.select(data, files, require_convertible=args.require_convertible, **_chosen(args))
        if args.text:
            chosen.write.mode("overwrite").json(args.save) if args.save else None
            show_lines(dataset_lines(chosen))
        else:
            report(chosen, args.save)
        if args.show_files:
            show(bucket_histogram(kept))
    elif args.command == "verify":
        links = verify_links(spark.read.json(args.files), _fetcher(args))
        links.write.mode("overwrite").json(config.path("links"))
        links = spark.read.schema(links.schema).json(config.path("links"))
        if args.text:
            show_lines(link_lines(links))
        else:
            show(link_report(links, ["series_id"]))
        show(link_report(links, []))
    elif args.command == "download":
        files = filter_files(classify_files(spark.read.json(args.files)), args.format, args.modality)
        if args.series:
            chosen, _ = engine.select(engine.classify(_first(spark.read.json(args.series), args.limit))[0], files, **_chosen(args))
            files = selected(files, chosen)
        elif args.domain or args.organism:
            raise SystemExit("--domain and --organism need --series")
        elif args.limit is not None:
            files = selected(files, _first(files.select("series_id").distinct(), args.limit))
        got = engine.download(files, _fetcher(args), args.target)
        report(got, args.save)
    elif args.command == "manifest":
        print(engine.write_manifests(spark.read.json(args.series), spark.read.json(args.files)))
    elif args.command == "organize":
        print(engine.organize(spark.read.json(args.files), spark.read.json(args.series)))
    elif args.command == "layout":
        report(engine.lay_out(args.folder, spark.read.json(args.series) if args.series else None, args.mode), None)
    elif args.command == "gap":
        every = spark.read.json(args.candidates)
        data, files = engine.classify(_first(every, args.limit))
        data, _ = engine.select(data, files, domain=args.domain, organism=args.organism, require_format=args.require_format, formats=args.format)
        found = data.join(spark.read.json(args.candidates).select("series_id", "organ", "pos"), "series_id")
        meta = spark.read.json(args.manifests).select("geo_metadata.*")
        gaps = engine.gaps(meta, found, files, args.format, modality=args.modality or "rna")
        report(gaps, args.save)
        if args.download_top:
            best = gaps.select(F.explode("candidates").alias("c")).where(F.col("c.rank") <= args.download_top).select("c.series_id").distinct()
            show(engine.download(filter_files(files, args.format).join(best, "series_id", "left_semi"), _fetcher(args), args.target or config.path("files")))
    elif args.command == "run":
        data, files = engine.classify(_first(spark.read.json(args.series), args.limit))
        chosen, kept = engine.select(data, files, require_convertible=True, **_chosen(args))
        report(chosen, args.save)
        show(engine.download(kept, _fetcher(args), args.target))
        show(engine.convert(args.target, args.qc).groupBy("series_id", "sample").count())
    elif args.command == "normalize":
        show(engine.place_matrices(args.folder, spark.read.json(args.series) if args.series else None, args.qc, args.meta_only))
    elif args.command == "convert":
        show(engine.convert(args.folder, args.qc).groupBy("series_id", "sample").count())
    else:
        from quarry.catalogue import QUERIES

        show(QUERIES[args.name](spark, args.folder))
    return 0


if __name__ == "__main__":
    sys.exit(main())
