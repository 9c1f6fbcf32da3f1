"""Many equal rows without a key, pages that could make a parser quadratic, and filters on the verdict of a scan."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest

from quarry.llm import html_nodes, minimax_shards, packing, secrets
from tests.llm.conftest import SCHEMA, row


@pytest.fixture(scope="module")
def equal_rows(spark):
    return spark.range(30_000).selectExpr("cast(null as long) as doc_id", "'the very same short text' as text", "id").cache()


def test_equal_rows_without_a_key_are_packed_by_many_tasks(equal_rows):
    got = packing.pack_documents(equal_rows, packing.PackSpec(task_pieces=3000)).select("length", "sequence_id", "offset").collect()
    assert len(got) == 30_000
    by_task = Counter(r.sequence_id >> 32 for r in got)
    assert len(by_task) == 10 and max(by_task.values()) < 1.2 * 3000
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= sum(r.length for r in got) / 2048 + 20


def test_equal_rows_without_a_key_are_numbered_by_many_slices(equal_rows):
    spec = minimax_shards.ShardSpec()
    out = minimax_shards.shard_documents(equal_rows, spec=spec)
    got = out.select("shard", "slot").collect()
    assert sorted(r.slot for r in got) == list(range(30_000)) and len({r.shard for r in got}) == 1


def test_a_filter_on_the_verdict_gives_what_the_scan_gives(spark):
    r = random.Random(1)
    texts = [f"api_key = '{''.join(r.choice('abcdefXYZ0123456789') for _ in range(32))}' and sha256: {'ab12' * 16}, token: plainword, password: hunter{i}" for i in range(20)] + [None, "", "author of secretary prose", "a" * 50_000 + "1"]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    found = secrets.scan(docs, secrets.train(spark))
    every = found.collect()
    assert every and {tuple(x) for x in found.where("is_secret").collect()} == {tuple(x) for x in every if x.is_secret}
    assert {tuple(x) for x in found.where("score > 0.9").collect()} == {tuple(x) for x in every if x.score > 0.9}
    walks = lambda df: df._jdf.queryExecution().executedPlan().toString().count("aggregate(")
    assert walks(found.where("is_secret")) == walks(found)  # the filter stands above the trees and doesn't hold them again


def test_scores_by_walking_are_those_of_the_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.random((300, 5))
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    forest = secrets.fit_forest(x, y, secrets.ForestSpec(trees=7, depth=4))
    df = spark.createDataFrame(x.tolist(), list("abcde"))
    got = [v[0] for v in df.select(secrets.as_column(forest, list("abcde"))).collect()]
    assert got == pytest.approx(secrets.predict(forest, x).tolist())


@pytest.mark.parametrize("page", ["<div>{n}</foo>{n}", "<div>{n}<li>a{n}", "<p><td><span>{n}</p>{n}", "<p><b>{n}<div></div>{n}", "<table>{n}<tr><td>{n}"])
def test_parsing_time_follows_the_length(page):
    def seconds(n):
        parts = page.split("{n}")
        text = "".join(p * n for p in parts)
        began = time.process_time()
        html_nodes.parse(text)
        return time.process_time() - began

    seconds(2000)
    assert seconds(100_000) < 30 * max(seconds(10_000), 0.02)
