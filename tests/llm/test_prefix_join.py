from __future__ import annotations

import random

from quarry.llm.prefix_join import JoinSpec, near_duplicates, shingles, sketch
from quarry.llm.text import WordHash
from tests.llm.conftest import SCHEMA, prose, row


def brute(rows):
    """Component by all pairs of exact sets of word tuples."""

    def parts(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        for s in "\t\n\r\x0b\x0c":
            w = w.replace(s, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(parts(t))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in keys}


def check(spark, rows, **spec):
    docs = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(3)
    got = near_duplicates(docs, spec=JoinSpec(**spec)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    return got


def test_odd_rows(spark, odd_docs, odd_rows):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    want = brute([(r[0], r[1]) for r in odd_rows if r[0] is not None])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert sizes[300] == sizes[301] == sizes[302] == 0 and sizes[303] == sizes[304] == 1
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_chains_and_rings_against_all_pairs(spark):
    r = random.Random(1)
    base = prose(r, 120).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):  # edits of varying size: some link to the base, some only to each other, some to none
        words = list(base)
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            words[r.randrange(len(words))] = f"edit{i % 7}x{r.randint(0, 3)}"
        rows.append((i, " ".join(words)))
    passage = prose(r, 60)
    rows += [(100 + i, passage + " " + prose(r, r.randint(3, 40))) for i in range(40)]
    check(spark, rows)
    check(spark, rows, first_pivots=1, growth=2)


def test_short_sets_at_the_threshold(spark):
    words = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(words[: 14 - i])) for i in range(10)] + [(50, "a b c d"), (51, "a b c d e"), (52, "A B c D")]
    check(spark, rows)


def test_hashes_and_sketch():
    t = WordHash(limit=3)
    a, b = shingles(b"the cat sat on the mat today", 5, t), shingles(b"THE cat  sat\non the mat today", 5, WordHash())
    assert (a == b).all() and len(a) == 3
    assert len(shingles(None, 5, t)) == 0 and len(shingles(b"x y", 5, t)) == 1
    x, y = sketch(a, 2), sketch(a[:2], 2)
    assert sum(bin(int(v) & (2**64 - 1)).count("1") for v in x ^ y) <= 1


def test_prefix_rules():
    s = JoinSpec()
    for n in range(1, 400):
        assert s.prefix(n) == n - s.alpha(n) + 1 and 1 <= s.head(n) <= n
        for m in range(s.alpha(n), n + 1):  # heads of sets that link share at least need - 1 hashes, one at least
            a = max(s.alpha(n), s.alpha(m))
            shared = min(s.head(n) - (n - a), s.head(m) - (m - a))
            assert shared >= max(1, s.need(n) - 1) or s.head(n) == n
