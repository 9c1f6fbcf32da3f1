from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.operators import datasets, lookup, matrix, ranking, rules


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- rules


def plain_domain(t):
    """Domain by counts, in plain Python."""
    t = t.lower()
    found = {d: [p for p in ps if re.search(p, t, re.I)] for d, ps in lexicon.DOMAIN_PATTERNS.items()}
    n = {d: len(f) for d, f in found.items()}
    if not any(n.values()):
        return "unknown", []
    if n["cancer"] >= 2:
        return "cancer", found["cancer"]
    if n["cancer"] == 1 and n["development"] > 2:
        return "development", found["development"]
    best = max(n, key=n.get)
    return best, found[best]


def test_domain_scores(spark):
    texts = ["", "breast cancer", "tumor", "tumor in fetal embryo development", "we saw signals in all cells", "healthy donor atlas of normal lung", "COVID infection and fibrosis", "stem cell trajectory time course", "alzheimer embryo"]
    rows = frame(spark, list(enumerate(texts)), "i int, t string").select("i", rules.domain_score(F.col("t")).alias("d")).orderBy("i").collect()
    assert [(r.d.domain, r.d.keywords) for r in rows] == [plain_domain(t) for t in texts]


def test_patterns_find_what_sql_finds(spark):
    texts = ["vitalsé", "alsо", "an als\u00e9 or ibd\u0301", "éall", "ſepsis", "ſtroke and time courſe", "TİME COURSE", "basal\x0bcell", "fetal\rx atlas", "fetal\nx atlas", "fetal\u2028x atlas", "breaſt cancer", "\u212aidney", "ſclc", "ibdſ", "hepatitiſ"]
    patterns = [p for ps in lexicon.DOMAIN_PATTERNS.values() for p in ps]
    rows = frame(spark, list(enumerate(texts)), "i int, t string").select("i", rules.domain_score(F.col("t")).alias("d"), *(rules.has_pattern(F.lower("t"), p).alias(f"p{n}") for n, p in enumerate(patterns))).orderBy("i").collect()
    import duckdb

    c = duckdb.connect()
    for r, t in zip(rows, texts, strict=True):
        want = c.execute("select list(regexp_matches(lower(?), '(?i)' || p) order by n) from (select unnest(?) as p, unnest(range(?)) as n)", [t, patterns, len(patterns)]).fetchall()[0][0]
        if "İ" not in t:  # its lower case is made by domain_score
            assert [r[f"p{n}"] for n in range(len(patterns))] == want, t
    assert [r.d.domain for r in rows if r.i in (0, 4, 6)] == ["disease", "disease", "development"]


def test_file_rules(spark):
    names = {
        "ftp://x/GSM1_filtered_feature_bc_matrix.h5": ("h5_10x_filtered_feature", "rna", "filtered", True),
        "x/matrix.mtx.gz": ("mtx_matrix", "unknown", "unknown", True),
        "x/Barcodes.tsv.gz/": ("mtx_barcodes", "unknown", "unknown", False),
        "x/atac_fragments.tsv.gz": ("fragments", "atac", "unknown", False),
        "x/y_RAW.tar": ("tar", "unknown", "unknown", False),
        "x/gene_counts.csv.gz": ("csv", "rna", "unknown", True),
        "x/metadata_counts.txt": ("tsv", "unknown", "unknown", False),
        "x/external.rds": ("rds", "rna", "unknown", False),
        "x/data.h5ad": ("h5ad", "unknown", "unknown", True),
        "x/notes.pdf": ("unknown", "unknown", "unknown", False),
    }
    got = rules.classify_files(frame(spark, [(n,) for n in names], "url string")).collect()
    assert {r.url: (r.format_type, r.modality_signal, r.processing_level, r.is_count_matrix) for r in got} == names


def test_names_and_buckets(spark):
    x = frame(spark, [("GSM9 my atac!file.tsv.gz",), (".hidden",), ("plain",), ("a.h5.gz",), ("b.tar.gz",), ("c.txt",)], "n string")
    got = {r[0]: tuple(r)[1:] for r in x.select("n", rules.canonical_name(F.lit("gse1"), F.col("n")), rules.download_bucket(F.col("n")), rules.converter_format(F.col("n"))).collect()}
    assert got["GSM9 my atac!file.tsv.gz"] == ("GSE1__GSM9__atac__GSM9_my_atac_file.tsv.gz", "csv_tsv", "tsv")
    assert got[".hidden"][0] == "GSE1__NA__unknown__.hidden" and got["plain"][1:] == ("other", "unknown")
    assert got["a.h5.gz"][1:] == ("h5", "gz") and got["b.tar.gz"][1:] == ("tar", "tar") and got["c.txt"][1:] == ("csv_tsv", "tsv")


def test_first_matches(spark):
    x = frame(spark, [("renal and Lung",), ("adrenal",), ("nothing",), (None,)], "t string").select(rules.organ_first(F.col("t"))).collect()
    assert [r[0] for r in x] == ["lung", "kidney", "unknown", "unknown"]
    q = frame(spark, [("Human scATAC and CITE-seq",), ("mouse spatial scRNA",), ("yeast",)], "q string").select(rules.parse_query(F.col("q")).alias("p")).select("p.*").collect()
    assert [(r.organism, r.assay) for r in q] == [("Homo sapiens", "scATAC-seq"), ("Mus musculus", "Spatial"), ("", "")]
    m = frame(spark, [("Paired RNA and ATAC", ""), ("x", lexicon.EXPRESSION_TYPE), ("CITE-seq", lexicon.EXPRESSION_TYPE), ("y", None)], "t string, s string")
    assert [r[0] for r in m.select(rules.modalities_of_text(F.col("t"), F.col("s"))).collect()] == [["atac", "multiome", "rna"], ["rna"], ["cite"], []]
    assert frame(spark, [(["a", "b.h5"],), (["b.h5", "a"],)], "n array<string>").select(rules.looks_single_cell(F.col("n"))).collect() == [(True,), (False,)]


# ---- datasets


def files(spark, *names, series="S"):
    return rules.classify_files(frame(spark, [(series, i, n) for i, n in enumerate(names)], "series_id string, pos int, url string"))


def test_triplets_and_convertibles(spark):
    flags = lambda *n: datasets.dataset_flags(files(spark, *n)).first()
    assert flags("matrix.mtx", "barcodes.tsv").has_mtx_triplet and not flags("barcodes.tsv", "features.tsv").has_mtx_triplet
    assert not flags("x.tar").is_convertible and not flags("metadata.csv").is_convertible and flags("gene_counts.csv.gz").is_convertible
    both = flags("a_filtered_feature_bc_matrix.h5", "b_atac_fragments.tsv.gz")
    assert both.modalities == ["atac", "multiome", "rna"] and both.available_formats == "filtered_feature_bc.h5, fragments.tsv"
    assert flags("x.loom").modalities == [] and flags("notes.pdf").available_formats == "none"
    probed = files(spark, "RAW.tar").withColumn("probed", F.lit(False)).unionByName(files(spark, "barcodes.tsv").withColumn("probed", F.lit(True)))
    assert datasets.dataset_flags(probed, probed="probed").first().has_mtx_triplet


def test_file_filters(spark):
    f = files(spark, "a.h5ad", "b.loom", "c_counts.csv", "d_atac.rds")
    names = lambda d: sorted(r.url for r in d.collect())
    assert names(datasets.filter_files(f, [])) == names(f)
    assert names(datasets.filter_files(f, ["LOOM "])) == ["b.loom"] and names(datasets.filter_files(f, ["nothing"])) == []
    assert names(datasets.filter_files(f, ["count_matrix"])) == ["a.h5ad", "b.loom", "c_counts.csv"]
    assert names(datasets.filter_files(f, modality="rna")) == ["a.h5ad", "b.loom", "c_counts.csv"]


def test_download_order(spark):
    f = frame(spark, [("A", 1, "x.pdf", None), ("A", 2, "m.tar", 9), ("A", 3, "d.h5ad", 7 * 1024**3), ("B", 1, "only.pdf", None), ("B", 2, "more.doc", 5)], "series_id string, pos int, url string, size long")
    got = [(r.series_id, r["rank"], r.url) for r in datasets.download_order(f, size="size").orderBy("series_id", "rank").collect()]
    assert got == [("A", 1, "m.tar"), ("B", 1, "only.pdf"), ("B", 2, "more.doc")]


def test_places(spark):
    t = frame(spark, [("GSE1", "/d/GSE1"), ("gse2", "/d/GSE2"), ("GSE3", "/d/GSE3"), ("GSE4", "/d/a/GSE4")], "series_id string, path string")
    e = frame(spark, [("GSE1", "/d/GSE1"), ("GSE1", "/d/GSE1/raw"), ("GSE2", "/old/GSE2"), ("GSE4", "/d/a")], "series_id string, path string")
    assert sorted(r.series_id for r in datasets.not_elsewhere(t, e).collect()) == ["GSE1", "GSE3", "GSE4"]
    p = frame(spark, [(0, "/o/GSE1_x.h5ad"), (1, "/o/GSE1_merged.h5ad"), (2, "/o/gse1.h5ad"), (3, "/o/GSE2_b.h5ad"), (4, "/o/GSE2_a.h5ad"), (5, "/o/none.h5ad")], "pos int, path string")
    assert {r.series_id: r.path for r in datasets.best_output(p).collect()} == {"GSE1": "/o/gse1.h5ad", "GSE2": "/o/GSE2_b.h5ad"}
    m = frame(spark, [("F", n) for n in ("s1_matrix.mtx.gz", "s2_matrix.mtx.gz", "s2_x_barcodes.tsv.gz", "s1_barcodes.tsv", "s2_x_genes.tsv")], "folder string, name string")
    r = datasets.matrix_triplets(m).first()
    assert (r.matrix, r.barcodes, r.features, r.score) == ("s2_matrix.mtx.gz", "s2_x_barcodes.tsv.gz", "s2_x_genes.tsv", 2)


# ---- ranking


def test_fusion(spark):
    lists = [frame(spark, [("a", 1), ("b", 2)], "k string, rank int"), frame(spark, [("b", 1), ("c", 2)], "k string, rank int")]
    got = {r.k: r.rrf for r in ranking.reciprocal_rank_fusion(lists, "k").collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})
    assert [r.k for r in ranking.fuse(lists, "k", 9).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.k for r in ranking.fuse(lists, "k", 1).collect()] == ["b"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.permutations(list("abcdef")), min_size=2, max_size=3), st.randoms())
def test_fusion_ignores_order_of_lists(spark, lists, r):
    dfs = [frame(spark, [(k, i + 1) for i, k in enumerate(x)], "k string, rank int") for x in lists]
    mixed = list(dfs)
    r.shuffle(mixed)
    one, two = ({x.k: round(x.rrf, 12) for x in ranking.reciprocal_rank_fusion(d, "k").collect()} for d in (dfs, mixed))
    assert one == two


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12), st.integers(0, 120))
def test_budget_cut_is_a_prefix(spark, sizes, budget):
    got = sorted(r.i for r in ranking.budget_prefix(frame(spark, list(enumerate(sizes)), "i int, n int"), F.col("n"), ["i"], budget).collect())
    want, run = [], 0
    for i, n in enumerate(sizes):
        if run + n > budget and want:
            break
        want.append(i)
        run += n
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(["x", "x-1", "x-2", "y", "y-1-1"]), min_size=1, max_size=10))
def test_unique_names_are_unique(spark, names):
    got = [r.unique_name for r in ranking.make_unique(frame(spark, list(enumerate(names)), "i int, n string"), "n", "i").orderBy("i").collect()]
    assert len(set(got)) == len(names)
    first = {n: names.index(n) for n in names}
    assert all(got[i] == n for n, i in first.items())


def test_unique_names_count_up(spark):
    got = [r.unique_name for r in ranking.make_unique(frame(spark, list(enumerate("xxyx")), "i int, n string"), "n", "i").orderBy("i").collect()]
    assert got == ["x", "x-1", "y", "x-2"]


def test_orders(spark):
    d = frame(spark, [(1, "2020"), (2, None), (3, "2021"), (4, "2021")], "i int, date string")
    assert [r.i for r in ranking.by_recency(d, "date", "i").collect()] == [3, 4, 1, 2]
    v = frame(spark, [("g", 1, [1.0, 0.0], 0.9), ("g", 2, [1.0, 0.0], 0.89), ("g", 3, [0.0, 1.0], 0.5)], "g string, k int, v array<double>, rel double")
    got = {r.k: r.mmr_rank for r in ranking.max_marginal_relevance(v, "g", "k", "v", "rel").collect()}
    assert got == {1: 1, 3: 2, 2: 3}
    s = frame(spark, [(i,) for i in range(50)], "i int")
    assert ranking.sample_rows(s, "i", 9).collect() == ranking.sample_rows(s.repartition(7), "i", 9).collect()


# ---- lookups


def test_lookup_order(spark):
    terms = frame(spark, [("CL", "1", "Cell A", 0), ("CL", "2", "cell b", 1), ("CL", "3", "CELL A", 2)], "onto string, id string, name string, pos int")
    syns = frame(spark, [("CL", "1", "shared", 0), ("CL", "2", "shared", 1), ("CL", "1", "cell b", 2)], "onto string, id string, syn string, pos int")
    look = lookup.build_lookup(terms, syns)
    assert {r.key: r.id for r in look.collect()} == {"cell a": "3", "cell b": "2", "shared": "1"}
    wanted = frame(spark, [("cell_type", " Shared\t"), ("tissue", "shared"), ("other", "cell b"), ("cell_type", "no")], "category string, raw string")
    got = {(r.category, r.raw): (r.id, r.method) for r in lookup.exact_matches(wanted, look, terms).collect()}
    assert got == {("cell_type", " Shared\t"): ("1", "exact"), ("tissue", "shared"): (None, "none"), ("other", "cell b"): ("2", "exact"), ("cell_type", "no"): (None, "none")}
    near = lookup.nearest_matches(frame(spark, [("q", [1.0, 0.1]), ("r", [-1.0, 0.0])], "raw string, vec array<double>"), frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>"))
    assert [(r.raw, r.id) for r in near.collect()] == [("q", 1)]


def test_expansion(spark):
    look = frame(spark, [("CL", "t cell", "7"), ("MONDO", "flu", "9")], "onto string, key string, id string")
    syns = frame(spark, [("CL", "7", s, i) for i, s in enumerate("abcd")] + [("MONDO", "9", "grippe", 0)], "onto string, id string, syn string, pos int")
    q = frame(spark, [(1, "find", " T cell", "FLU"), (2, "none", "", None)], "query_id int, query string, cell_type string, disease string")
    got = {r.query_id: r.expanded for r in lookup.expand_queries(q, ["cell_type", "disease"], look, syns).collect()}
    assert got == {1: "find a b c grippe", 2: "none"}


# ---- matrices


def test_matrix_filters(spark):
    rows = [(f"c{c}", g, 1.0) for c in range(4) for g in ("A", "B", "MT-1")] + [("c9", "A", 5.0), ("c3", "C", 1.0), ("c0", "MT-1", 50.0)]
    m = frame(spark, rows, "cell string, gene string, value double").groupBy("cell", "gene").agg(F.sum("value").alias("value"))
    got = {(r.cell, r.gene) for r in matrix.quality_filter(m, 2, 2, 40.0).collect()}
    assert got == {(f"c{c}", g) for c in (1, 2, 3) for g in ("A", "B", "MT-1")}
    wide = frame(spark, [("x", 1.0, 0.0), ("y", None, 2.0)], "cell string, g1 double, g2 double")
    assert sorted((r.cell, r.gene, r.value) for r in matrix.wide_to_rows(wide, "cell").collect()) == [("x", "g1", 1.0), ("y", "g2", 2.0)]
    assert matrix.needs_transpose(2, 11) and not matrix.needs_transpose(2, 10)
    both = matrix.merge_samples({"s": m, "t": m})
    assert both.count() == 2 * m.count()
