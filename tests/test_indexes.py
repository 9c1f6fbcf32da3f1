"""Postings, cells, many queries in one plan, versions and line numbers, each against a plain version."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.plans.postings import Postings, postings, write_postings
from quarry.plans.retrieve import RetrievalSpec, merge_many, retrieve, retrieve_many, sparse_top
from quarry.plans.vector_index import CellSpec, VectorIndex, dense_top_many, write_cells
from quarry.providers import Providers
from quarry.sources.matrices import numbered_lines, scan_lines
from quarry.versions import CommitConflict, VersionedTable

WORDS = "lung heart tumor cell mouse human rna atac brain skin".split()


@pytest.fixture(scope="module")
def index(spark):
    r = random.Random(1)
    n = np.random.default_rng(1)
    rows = [(f"GSE{i}", " ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))), n.normal(size=8).tolist() if i % 7 else None, r.choice(["a", "b", None])) for i in range(300)]
    rows.append(("GSE900", None, [0.0] * 8, "a"))
    return spark.createDataFrame(rows, "gse_id string, document_text string, vec array<double>, organism string").repartition(3).cache()


def plain(rows):
    return [tuple(r) for r in rows]


def test_postings_give_what_the_texts_give(spark, index, tmp_path):
    write_postings(index, str(tmp_path), buckets=8)
    p = Postings(spark, str(tmp_path))
    assert p.buckets == 8
    for q in ("lung tumor", "Lung lung RNA", "nothing here", ""):
        want = plain(sparse_top(index, q, 20).orderBy("rank").collect())
        assert plain(p.top(q, 20).orderBy("rank").collect()) == want
    plan = p.of(["lung"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,lung)" in plan or "In(token, [lung])" in plan
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters:")[1][:200]
    few = {r.token: r.df for r in p.tokens.collect()}
    assert few["lung"] == index.where("array_contains(split(document_text, ' '), 'lung')").count()
    among = index.where("organism = 'a'").select("gse_id")
    assert {r.gse_id for r in p.top("lung", 500, among).collect()} <= {r.gse_id for r in among.collect()}


def _exchanges(df):
    """What the shuffles of a plan deal rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


def test_postings_shuffle_texts_and_no_tokens(spark, tmp_path):
    rows = [("a", "lung Lung cell"), ("b", "cell"), ("a", "lung"), ("b", None), (None, "cell"), (None, "cell")]
    got = postings(spark.createDataFrame(rows, "gse_id string, document_text string"), "gse_id", "document_text")
    assert _exchanges(got) == ["gse_id"]
    assert {tuple(r) for r in got.collect()} == {("lung", "a", 3), ("cell", "a", 1), ("cell", "b", 1), ("cell", None, 2)}


def test_many_queries_meet_postings_where_their_document_lies(spark, index, tmp_path):
    write_postings(index, str(tmp_path), buckets=4)
    queries = spark.createDataFrame([(i, f"{w} tumor") for i, w in enumerate(WORDS)], "query_id int, query string")
    got = Postings(spark, str(tmp_path)).top_many(queries, 5)
    assert [x for x in _exchanges(got) if "gse_id" in x] == ["gse_id"]  # never by query and document
    for i, w in enumerate(WORDS):
        want = plain(sparse_top(index, f"{w} tumor", 5).orderBy("rank").collect())
        assert plain(got.where(F.col("query_id") == i).orderBy("rank").drop("query_id").collect()) == want


def vectors(n, dims, seed, centres=None):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dims)) if centres is None else centres[r.integers(0, len(centres), n)] + 0.15 * r.normal(size=(n, dims))


def exact(x, q, k):
    norm = lambda a: np.sqrt((a * a).sum(1)) + 1e-10
    cos = np.round(q @ x.T / (norm(q)[:, None] * norm(x)), 9)
    return [sorted(range(len(x)), key=lambda j: (-cos[i, j], j))[:k] for i in range(len(q))]


@pytest.mark.parametrize("spread", [False, True])
def test_cells_are_exact_by_bounds_and_mostly_right_without(spark, tmp_path, spread):
    centres = None if spread else np.random.default_rng(5).normal(size=(20, 16))
    x, q = vectors(3000, 16, 1, centres), vectors(60, 16, 2, centres)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, x[0].tolist())]
    write_cells(spark.createDataFrame(rows, "id long, vec array<double>").repartition(3), str(tmp_path), "id", "vec", CellSpec(per_cell=150, sample=1000))
    held = VectorIndex(spark, str(tmp_path), "id", "vec")
    assert len(held.cells) > 10 and held.n.sum() == 3001
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())] + [(100, None), (101, [0.0] * 16)], "query_id int, vec array<double>")
    got = {}
    for r in held.search(asked, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    y = np.vstack([x, x[:1]])
    assert got == {i: [9003 if j == 3000 else j for j in js] for i, js in enumerate(exact(y, q, 5))}
    if not spread:
        assert held.recall(asked, 5, 3) >= 0.95
    assert held.search(asked, 4000).where("query_id = 0").count() == 3001  # more than there are


def test_matches_above_a_threshold_are_exact_and_agree(spark, tmp_path):
    centres = np.random.default_rng(5).normal(size=(12, 8))
    x, q = vectors(2000, 8, 3, centres), vectors(80, 8, 4, centres)
    rows = [(f"i{i:05}", v, "ab"[i % 2]) for i, v in enumerate(x.tolist())]
    write_cells(spark.createDataFrame(rows, "id string, vec array<double>, onto string"), str(tmp_path), "id", "vec", CellSpec(per_cell=100), ["onto"])
    held = VectorIndex(spark, str(tmp_path), "id", "vec")
    asked = spark.createDataFrame([(i, v, "ab"[i // 40]) for i, v in enumerate(q.tolist())] + [(99, [0.0] * 8, "a")], "query_id int, vec array<double>, onto string")
    for least in (0.5, 0.95, 0.999):
        want = {}
        for i, v in enumerate(q):
            few = [j for j in range(len(x)) if rows[j][2] == "ab"[i // 40]]
            cos = np.round(x[few] @ v / ((np.sqrt((x[few] ** 2).sum(1)) + 1e-10) * (np.sqrt(v @ v) + 1e-10)), 9)
            if cos.max() >= least:
                want[i] = (rows[few[int(cos.argmax())]][0], pytest.approx(cos.max(), abs=2e-9))
        got = {r.query_id: (r.id, r.score) for r in held.matches(asked, least, ["onto"]).collect()}
        assert got == want
    visits = held._visits(asked, "query_id", "vec", None, 1, least_score=0.95, by=["onto"]).count()
    assert visits < 0.5 * 80 * len(held.cells)  # most cells are ruled out


def test_an_empty_vector_index(spark, tmp_path):
    write_cells(spark.createDataFrame([("a", None)], "gse_id string, vec array<double>"), str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id int, vec array<double>")
    assert VectorIndex(spark, str(tmp_path)).search(asked, 3).collect() == []


def test_a_hundred_queries_in_one_plan(spark, index, tmp_path):
    r = random.Random(4)
    enc = np.random.default_rng(9)
    asked = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 5))), enc.normal(size=8).tolist(), r.choice(["a", None])) for i in range(100)]
    queries = spark.createDataFrame(asked, "query_id int, query string, vec array<double>, organism string")
    write_postings(index, str(tmp_path / "p"), buckets=4)
    write_cells(index, str(tmp_path / "v"), spec=CellSpec(per_cell=50))
    held = {"postings": Postings(spark, str(tmp_path / "p")), "cells": VectorIndex(spark, str(tmp_path / "v"))}
    columns = ("query_id", "gse_id", "rank", "dense_score", "sparse_score", "rrf", "rerank_score")
    for spec, names in ((RetrievalSpec(), ["organism"]), (RetrievalSpec(strategy="hybrid+rerank"), None), (RetrievalSpec(strategy="dense+filter", filter_scope="both"), ["organism"]), (RetrievalSpec(strategy="sparse+filter", filter_scope="both"), ["organism"])):
        plans = [retrieve_many(index, queries, spec, names), retrieve_many(index, queries, spec, names, postings=held["postings"], cells=None if names else held["cells"])]
        found = []
        for p in plans:
            got = {}
            for row in p.select(*columns).collect():
                got.setdefault(row.query_id, []).append(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in row[1:]))
            found.append({k: sorted(v) for k, v in got.items()})
        assert found[0] == found[1]
        for i, text, vec, organism in asked[::9]:
            one = retrieve(index, text, vec, spec, {"organism": organism} if organism else None).select(*columns[1:]).collect()
            want = sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in row) for row in one)
            assert found[0].get(i, []) == want, (spec, i)


def test_merged_results_of_many_queries(spark):
    a = spark.createDataFrame([(1, "x", 1, 0.5, None), (1, "y", 2, 0.4, 3), (2, "x", 1, 0.1, None)], "query_id int, gse_id string, rank int, dense_score double, sparse_score int").withColumn("rrf", F.lit(0.0))
    b = spark.createDataFrame([(1, "z", 1, 0.9, None), (1, "x", 2, 0.8, 9)], "query_id int, gse_id string, rank int, dense_score double, sparse_score int").withColumn("rrf", F.lit(0.0))
    got = {(r.query_id, r["rank"]): (r.gse_id, r.dense_score) for r in merge_many(a, b, "gse_id", 2).collect()}
    assert got == {(1, 1): ("x", 0.5), (1, 2): ("z", 0.9), (2, 1): ("x", 0.1)}


def test_versions_are_whole_or_not_there(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.current() is None and t.history() == []
    with pytest.raises(FileNotFoundError):
        t.read()
    one = t.replace(spark.range(3), "first")
    pinned = t.read()

    def broken(path):
        spark.range(5).write.parquet(path)
        raise RuntimeError("killed before the commit")

    with pytest.raises(RuntimeError):
        t.write(broken)
    assert t.current() == one and t.read().count() == 3
    two = t.replace(t.read().union(spark.range(10, 12)), "more")  # from its own former version
    assert pinned.count() == 3 and t.read().count() == 5 and t.read(1).count() == 3 and [v.note for v in t.history()] == ["first", "more"]
    with pytest.raises(CommitConflict):  # another writer that started from the first version
        t.write(lambda p: spark.range(1).write.parquet(p), base=one)
    assert t.current() == two and t.read().count() == 5
    (tmp_path / "t" / "_commits" / "00000003.json").write_text("")  # a commit that is being written
    assert t.current() == two
    (tmp_path / "t" / "_commits" / "00000003.json").unlink()
    assert len(t.vacuum(keep=1)) == 3 and t.read().count() == 5


def test_lines_of_one_file_are_numbered_over_splits(spark, tmp_path):
    n = 1_000_000
    (tmp_path / "barcodes.tsv").write_text("".join(f"c{i}\n" for i in range(n)))
    (tmp_path / "few.tsv").write_text("a\n\nb")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        scan_lines(spark, str(tmp_path)).write.parquet(str(tmp_path / "lines"))
        lines = spark.read.parquet(str(tmp_path / "lines"))
        assert lines.where("path like '%barcodes%'").select("block").distinct().count() > 8
        got = numbered_lines(lines)
        big = got.where("path like '%barcodes%'")
        assert big.where("value != concat('c', n)").count() == 0 and big.count() == n
        assert sorted((r.n, r.value) for r in got.where("path like '%few%'").collect()) == [(0, "a"), (1, ""), (2, "b")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_retrieval_reads_vectors_and_texts_apart(spark, index):
    texts, held = index.drop("vec"), index.select("gse_id", "vec").where("vec is not null")
    vec = [1.0, -1.0, 0.5, 0, 0, 0.2, 0, 1]
    one = retrieve(index, "lung tumor", vec, RetrievalSpec(), {"organism": "a"}, Providers()).select("gse_id", "rank", "dense_score", "sparse_score", "rerank_score")
    two = retrieve(texts, "lung tumor", vec, RetrievalSpec(), {"organism": "a"}, Providers(), vectors=held).select(*one.columns)
    assert sorted(plain(one.collect())) == sorted(plain(two.collect()))


def test_products_of_large_chunks_are_cut():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quarry.operators.lookup import best_cosines
    from quarry.plans.vector_index import top_cosines

    r = np.random.default_rng(5)
    v, q = r.integers(-2, 3, (40_000, 4)) + 0.5, r.integers(-2, 3, (256, 4)) + 0.5
    asked, held = pa.table({"q": range(len(q)), "_q": pa.array(q.tolist())}), pa.table({"k": range(len(v)), "v": pa.array(v.tolist())})
    tracemalloc.start()
    at, score = best_cosines(q, v, 9)
    found = top_cosines(asked, held, 3, "q", "k", "v", 9).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120_000_000  # all of it at once takes 82 MB for each copy
    size = lambda x: np.sqrt((x * x).sum(1)) + 1e-10
    cos = np.round(q @ v.T / (size(q)[:, None] * size(v)), 9)
    assert at.tolist() == cos.argmax(1).tolist() and score.tolist() == cos.max(1).tolist()
    assert found["k"] == np.argsort(-cos, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_blocks_and_chunks_meet_over_many_partitions(spark):
    n = np.random.default_rng(4)
    x = n.normal(size=(60, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, vec array<double>")
    asked = vectors.where("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[:20] @ unit.T
    former = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more data than one partition takes
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        for chunk, block in ((16, 16), (16, 7), (1000, 1000)):
            got = dense_top_many(vectors, asked, 5, "doc_id", "vec", chunk=chunk, block=block).collect()
            found = {(r.query_id, r["rank"]): r.doc_id for r in got}
            assert found == {(q, i + 1): d for q in range(20) for i, d in enumerate(np.argsort(-near[q])[:5].tolist())}
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)
