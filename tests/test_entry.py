from __future__ import annotations

import os

import pytest

import __spark_entry__
from quarry import catalogue

DATA = "/root/testdata/sf0.001"
FLOWS = [n for n, f in catalogue.QUERIES.items() if f.__module__.rsplit(".", 1)[1] in ("flows", "indexes", "engine_flows")]


def test_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and set(catalogue.QUERIES) <= set(q) and len(catalogue.QUERIES) >= 70


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["hybrid_rrf_topk", "dataset_flag_rows", "soft_sample_sections", "model_plan_rollup", "study_detail", *FLOWS])
def test_queries_give_what_their_sql_gives(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{f}')")
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = c.execute(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) or name == "open_downloads"  # few parts
    plain = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    rows = lambda d: sorted(str([plain(v) for v in r]) for r in d[cols].astype(object).values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def _vectors(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_ontology_nearest_asks_for_every_vector_without_a_label(spark, tmp_path):
    data = _vectors(spark, tmp_path, [(1, [1.0, 0.0], 0), (500, [1.0, 0.1], 0), (9000, [0.1, 1.0], 0), (2, [1.0, 0.0], 1), (700, [0.0, 1.0], 2)])
    got = {r.raw: r.id for r in catalogue.QUERIES["ontology_nearest"](spark, data).collect()}
    assert got == {1: 2, 500: 2, 9000: 700}


def test_mmr_reorder_takes_the_most_relevant_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), *((i, [0.0, 1.0], 1) for i in range(1, 60)), (99, [1.0, 0.1], 1)]
    got = catalogue.QUERIES["mmr_reorder"](spark, _vectors(spark, tmp_path, rows)).collect()
    assert len(got) == 50 and {0, 99} <= {r.vec_id for r in got}
