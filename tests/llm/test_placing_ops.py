from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np

from quarry.llm import learned_partitions, minimax_shards, mixing
from tests.llm.conftest import SCHEMA, row

# ---- shards


def greedy(weights, capacity):
    n, left = 1, capacity
    for w in weights:
        if w > left:
            n, left = n + 1, capacity
        left -= w
    return n


def smallest_capacity(weights, shards):
    low = max(max(weights), -(-sum(weights) // shards))
    while greedy(weights, low) > shards:
        low += 1
    return low


def check_shards(spark, rows, shards, **spec):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = minimax_shards.shard_documents(docs, spec=minimax_shards.ShardSpec(shards=shards, **spec)).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1] or "")
    place, slots, load = {}, defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        if len(set(texts[r.doc_id])) == 1:
            t = texts[r.doc_id][0]
            assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode())
            assert place.setdefault(t, r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_shards_of_odd_rows(spark, odd_rows, no_docs):
    check_shards(spark, odd_rows, 5)
    check_shards(spark, odd_rows, 40)
    check_shards(spark, odd_rows, 1)
    assert minimax_shards.shard_documents(no_docs).collect() == []


def test_capacity_is_the_smallest(spark):
    rng = np.random.default_rng(5)
    rows = [row(i, "x" * int(n) + str(i)) for i, n in enumerate(rng.integers(1, 400, 400))]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    order = docs.select(F.xxhash64("text").alias("h"), (F.octet_length("text") + 16).alias("w")).orderBy("h").collect()
    want = smallest_capacity([r.w for r in order], 7)
    for summary in (16, 64, 65_536):  # coarse summaries must end in the same cuts
        load = check_shards(spark, rows, 7, summary_rows=summary)
        assert max(load.values()) == want


def hash_order(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA).select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("w"))
    return [(r.h, r.w) for r in docs.groupBy("h").agg(F.sum("w").alias("w")).orderBy("h").collect()]


def check_contiguous(spark, rows, shards, **spec):
    """Shards are runs of the hash order, and the largest is as small as the brute force finds."""
    from pyspark.sql import functions as F

    load = check_shards(spark, rows, shards, **spec)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minimax_shards.shard_documents(docs, spec=minimax_shards.ShardSpec(shards=shards, **spec))
    by_hash = got.join(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")), "doc_id").select("h", "shard").distinct().orderBy("h").collect()
    places = [r.shard for r in by_hash]
    assert places == sorted(places)
    assert max(load.values()) == smallest_capacity([w for _, w in hash_order(spark, rows)], shards)
    return load


def test_giant_groups_stand_alone_in_the_order(spark):
    rows = [row(i, "copied text " * 20) for i in range(200)] + [row(1000 + i, f"other text {i} " * (i % 5 + 1)) for i in range(100)]
    giant = 200 * (len("copied text " * 20) + 16)
    for summary in (2, 16, 65_536):
        load = check_contiguous(spark, rows, 6, summary_rows=summary)
        rest = sorted(v for v in load.values() if v != giant)
        assert giant in load.values() and len(load) == 6 and rest[-1] < 3 * rest[0]  # the run before the giant is shorter
    more = rows + [row(2000 + i, "a second group of copies " * 9) for i in range(60)] + [row(3000 + i, "and a third one " * 5) for i in range(40)]
    for shards in (2, 3, 4, 5, 9):
        check_contiguous(spark, more, shards, summary_rows=16)
    check_contiguous(spark, more, 150)


def test_no_partition_of_small_orders_is_smaller(spark):
    import itertools

    rng = np.random.default_rng(2)
    for trial in range(3):
        rows = [row(i, f"t{trial} {i % 9} " + "y" * int(n)) for i, n in enumerate(rng.choice([1, 5, 60, 700], 11))]
        weights = [w for _, w in hash_order(spark, rows)]
        for shards in (2, 4):
            cuts = itertools.combinations(range(1, len(weights)), shards - 1)
            best = min(max(sum(weights[a:b]) for a, b in itertools.pairwise((0, *c, len(weights)))) for c in cuts)
            assert max(check_shards(spark, rows, shards, summary_rows=4).values()) == best


def test_many_groups_over_many_shards(spark):
    """Some 50,000 groups: hundreds of cells are open at once."""
    from pyspark.sql import functions as F

    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("z"), (F.col("id") * 7919 % 997).cast("int"))).alias("text"))
    docs = docs.union(spark.range(50_000, 54_000).select("id", F.lit("a text with many copies")))
    order = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 16).alias("w")).orderBy("h").collect()
    for shards, summary in ((40, 64), (40, 65_536), (300, 1024)):
        got = minimax_shards.shard_documents(docs, spec=minimax_shards.ShardSpec(shards=shards, summary_rows=summary)).groupBy("shard").agg(F.sum("size").alias("n")).collect()
        weights = [r.w for r in order]
        cap = max(r.n for r in got)
        assert greedy(weights, cap) <= shards and len(got) == shards
        assert cap == max(weights) or greedy(weights, cap - 1) > shards


# ---- mixing


def plain_mix(rows, spec):
    """Reference version with lists: water filling top-down, then prefixes of seeded epochs."""
    from hashlib import md5

    levels = len(spec.levels)
    words = lambda t: len((t or "").encode().split())
    leaves = defaultdict(list)
    for r in rows:
        leaves[r["path"]].append((r["doc_id"], words(r["text"])))
    tokens = {p: sum(n for _, n in ds) for p, ds in leaves.items()}
    cap = Counter()
    for p, n in tokens.items():
        for i in range(levels + 1):
            cap[p[:i]] += n * spec.max_epochs
    budget = {(): min(cap[()], sum(tokens.values()) * spec.budget_percent // 100)}
    for i in range(levels):
        for parent in [p for p in list(budget) if len(p) == i]:
            kids = sorted({p[: i + 1] for p in leaves if p[:i] == parent})
            known = spec.weights.get(spec.levels[i])
            w = {k: known.get(k[-1], spec.default_weight) if known else 1 for k in kids}
            open_, left = sorted(kids, key=lambda k: (cap[k] / w[k], k[-1])), budget[parent]
            full = []
            while open_ and left * w[open_[0]] >= cap[open_[0]] * sum(w[k] for k in open_):
                full.append(open_.pop(0))
                left -= cap[full[-1]]
            for k in full:
                budget[k] = cap[k]
            whole = sum(w[x] for x in open_)
            for k in open_:
                budget[k] = left * w[k] // whole
            extra = left - sum(budget[k] for k in open_) if open_ else 0
            for k in sorted(open_, key=lambda k: (-(left * w[k] % whole), k[-1]))[:extra]:
                budget[k] += 1
            assert sum(budget[k] for k in kids) == budget[parent]
    picked = Counter()
    for p, ds in leaves.items():
        n, b = tokens[p], budget[p]
        e, rest = (b // n, b % n) if n else (1, 0)
        for d, _ in ds:
            for k in range(e):
                picked[(d, *p, k)] += 1
        run = 0
        order = sorted(ds, key=lambda x: md5(f"{spec.seed}:{e}:{'' if x[0] is None else x[0]}".encode()).hexdigest())
        i = 0
        while rest > 0 and i < len(order):  # rows with one id stand or fall together
            same = [x for x in order if x[0] == order[i][0]]
            run += sum(n for _, n in same)
            if run > rest:
                break
            for d, _ in same:
                picked[(d, *p, e)] += 1
            i += len(same)
    return picked


def test_mix_against_plain_version(spark, odd_docs, odd_rows):
    for percent, bucket in ((60, 256), (60, 1), (250, 2), (1000, 256), (0, 256)):
        spec = mixing.MixSpec(budget_percent=percent, bucket_docs=bucket)
        got = mixing.mix_sources(mixing.with_domain(odd_docs), spec).collect()
        domains = mixing.DOMAINS
        rows = [{"doc_id": r[0], "text": r[1], "path": (domains.get(r[3], "other"), r[2] or "", r[3] or "")} for r in odd_rows]
        assert Counter((r.doc_id, r.domain, r.lang, r.source, r.epoch) for r in got) == plain_mix(rows, spec)


def test_mixed_documents_keep_columns(spark, odd_docs, no_docs):
    plan = Counter(r.doc_id for r in mixing.mix_sources(mixing.with_domain(odd_docs)).collect())
    docs = mixing.mixed_documents(mixing.with_domain(odd_docs)).select(odd_docs.columns)
    assert docs.columns == odd_docs.columns and Counter(r.doc_id for r in docs.collect()) == plan
    assert mixing.mix_sources(mixing.with_domain(no_docs)).collect() == []


def test_shortages_go_to_siblings_first(spark):
    rows = [row(i, "w " * 10, "en", "src0") for i in range(10)] + [row(100 + i, "w " * 10, "en", "src1") for i in range(100)] + [row(300 + i, "w " * 10, "en", "src5") for i in range(100)]
    docs = mixing.with_domain(spark.createDataFrame(rows, SCHEMA))
    spec = mixing.MixSpec(weights={"domain": {"web": 1, "books": 1}}, max_epochs=1, budget_percent=50)
    got = Counter(r.source for r in mixing.mix_sources(docs, spec).collect())
    assert got["src0"] == 10 and got["src1"] == 42 and got["src5"] == 52  # web keeps its half, src1 takes what src0 lacks


# ---- nearest neighbours


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int")


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.4).astype(np.float32)
    x[100:400] = x[0]  # many equal vectors
    spec = learned_partitions.PartitionSpec(parts=8, sample=1200, least_chunk=200)
    got = learned_partitions.search(vectors(spark, x), spec=spec).collect()
    found, hit = defaultdict(list), 0
    for r in got:
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(float)
    assert sorted(found) == list(range(0, 3000, 100))
    for q, rows in found.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(d)), d))[:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and all(abs(s - d[v]) < 1e-12 for _, v, s in rows)
        assert rows == sorted(rows, key=lambda r: (r[2], r[1]))
        hit += len(set(want) & {r[1] for r in rows})
    assert hit >= 0.9 * 10 * len(found)


def test_few_partitions_are_visited_and_shuffles_are_linear(spark):
    """Vectors with neighbourhoods: recall 0.9 at under a third of the partitions, whose number grows with the rows."""
    rng = np.random.default_rng(4)
    spec = learned_partitions.PartitionSpec()
    assert [spec.parts_of(n) for n in (0, 1, 2000, 51_282, 10**6, 10**9)] == [32, 32, 32, 128, 512, 1024]
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(0, 300, 20_000)] + rng.normal(size=(20_000, 32)) * 0.25
    parts = spec.parts_of(len(x))
    router = learned_partitions.fit_router(x[rng.choice(len(x), spec.sample_of(parts), replace=False)], spec, parts)
    home, asked = router.ranked(x, 1)[:, 0], np.arange(0, len(x), 100)
    near = learned_partitions._nearest(x[asked], x, 10, asked)
    seen = router.ranked(x[asked], router.visits)
    recall = np.mean([np.isin(home[n], p).mean() for n, p in zip(near, seen, strict=True)])
    assert recall >= 0.9 and router.visits < parts / 3, (recall, router.visits, parts)


def test_blocks_of_queries_give_the_same_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    df = vectors(spark, x).withColumnsRenamed({"label": "part"}).selectExpr("*", "1 as id", "2 as v", "3 as parts", "4 as chunk", "5 as asks")
    runs = [sorted(map(tuple, learned_partitions.search(df, spec=learned_partitions.PartitionSpec(every=3, parts=4, query_block=b, least_chunk=c, most_chunk=c)).collect())) for b, c in ((65_536, 65_536), (7, 31))]
    assert runs[0] == runs[1] and len(runs[0]) == 3000


def test_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0, 0.5]), (3, [0.0, 2.0, 0.0]), (4, [1.0, 1.0]), (0, [1.0, 0.0]), (100, [9.0, 9.0, 9.0])]
    got = learned_partitions.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 0.1), (0, 2, 4, 1.0), (100, 1, 2, 0.5), (100, 2, 3, 1.0)]


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.1]), (200, [])]
    got = learned_partitions.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert learned_partitions.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_small_tables_fill_all_ranks(spark):
    rng = np.random.default_rng(3)
    for n in (12, 40, 130):
        x = rng.normal(size=(n, 4))
        got = learned_partitions.search(vectors(spark, x), spec=learned_partitions.PartitionSpec(every=10, target=0.1)).collect()
        assert len(got) == -(-n // 10) * 10


def test_partitions_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 8))
    g = learned_partitions._nearest(x, x, 8, np.arange(800))
    label = learned_partitions.balanced_partition(x, g, 8, 1.1)
    assert np.bincount(label, minlength=8).max() <= 111
    cut = (label[np.repeat(np.arange(800), 8)] != label[g.ravel()]).mean()
    assert cut < (learned_partitions._median_splits(x, 8)[np.repeat(np.arange(800), 8)] != learned_partitions._median_splits(x, 8)[g.ravel()]).mean()
