"""Verdicts, scores and bins against plain versions and exhaustive search."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import zstandard

from quarry.llm import compression_bands, packing, toxicity
from tests.llm.conftest import SCHEMA, prose, row


def verdict(text, limits):
    """(base_failed, kept) of a text."""
    b = (text or "").encode()
    words = b.split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in zip(*(list(x) for x in np.unique(np.array([hash(g) for g in grams], dtype=np.int64), return_counts=True)), strict=True) if n > 1} if grams else set()
    inside = {i + k for i, g in enumerate(grams) if hash(g) in twice for k in range(5)}
    if len(words) < 10 or 100 * len(inside) > 20 * len(words):
        return True, False
    pack = lambda x: len(zstandard.ZstdCompressor(level=limits.level).compress(x)) / len(x)
    low, high = [(lo, hi) for start, lo, hi in limits.bands if start <= len(b)][-1]
    ok = low <= pack(b) <= high
    for o in range(0, len(b) if len(b) >= 4096 else 0, 4096):
        part = b[o : o + 4096]
        if len(part) >= 2048:
            ok = ok and 0.425 <= pack(part) <= 0.60
    return False, ok


def test_verdicts_of_bands(spark, odd_docs, odd_rows):
    r = random.Random(11)
    limits = compression_bands.BandLimits()
    texts = [prose(r, n) for n in (12, 30, 90, 400, 1500, 6000)] + [f"{i} item of the table {i * i}" * 40 for i in range(5)]
    texts += [" ".join("".join(chr(r.randint(33, 126)) for _ in range(9)) for _ in range(n)) for n in (20, 300, 2000)] + [prose(r, 900) + " " + "QUJD" * 3000 + " " + prose(r, 900)]
    rows = [*odd_rows, *(row(2000 + i, t) for i, t in enumerate(texts))]
    got = compression_bands.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()

    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((x.doc_id, x.base_failed, x.kept) for x in got), key=key) == sorted(((x[0], *verdict(x[1], limits)) for x in rows), key=key)
    assert {x.kept for x in got} == {True, False}


def test_scores_of_texts_word_by_word(spark, odd_rows):
    """The scorer again, one word and filter at a time."""
    spec = toxicity.ToxicSpec(buckets=512, dim=4, widths=(1, 2, 3), filters=2)
    rng = np.random.default_rng(8)
    widths = [w for w in spec.widths for _ in range(spec.filters)]
    tables = [rng.normal(size=(512, sum(w > j for w in widths))) for j in range(3)]
    for t in tables:
        t[0] = 0
    out, bias, cuts = rng.normal(size=6), rng.normal(size=6) * 0.1, np.array([0.5, -0.3, 0.2, 0.1, 0.0])
    model = toxicity.Model(spec, tables, bias, out, 0.3, cuts)
    rows = [x for x in odd_rows if x[0] != 400] + [row(500, "the cat AND the dog, with: this"), row(501, "le chat et les chiens dans une rue"), row(502, "zzz qqq")]
    got = toxicity.score(spark.createDataFrame(rows, SCHEMA).repartition(2), model).collect()

    def plain(text):
        body = "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in toxicity.string.punctuation:
            body = body.replace(c, " ")
        words = body.encode().split()
        ids = [[toxicity.xxhash.xxh3_64_intdigest(w[:n] if n else w, n) % 511 + 1 for n in (0, 4, 5)] for w in words] or [[0, 0, 0]]
        pooled = []
        for f, w in enumerate(widths):
            best = -math.inf
            for at in range(len(ids)):
                total = 0.0
                for j in range(w):
                    if at + j < len(ids):
                        column = f - (len(widths) - tables[j].shape[1])
                        total += sum(tables[j][b][column] for b in ids[at + j])
                best = max(best, total)
            pooled.append(max(0.0, best + bias[f]))
        own = {toxicity.xxhash.xxh3_64_intdigest(w.encode()) % 511 + 1: i for i, ws in enumerate(toxicity.FUNCTION_WORDS.values()) for w in ws.split()}
        votes = [sum(own.get(x[0], -1) == i for x in ids) if words else 0 for i in range(4)]
        lang = votes.index(max(votes)) if max(votes) else 4
        return 1 / (1 + math.exp(-(sum(p * o for p, o in zip(pooled, out, strict=True)) + 0.3 - cuts[lang])))

    want = {(x[0], x[1]): plain(x[1]) for x in rows}
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, []).append(v)
    for x in got:
        assert any(abs(x.score - v) < 1e-6 for v in by_id[x.doc_id]) and x.predicted == int(x.score >= 0.5)


def fewest(lengths, spec):
    """Fewest bins by trying all partitions."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best and i < len(lengths):
            return
        if i == len(lengths):
            best = min(best, len(bins))
            return
        for b in {tuple(b) for b in bins}:
            new = [*b, lengths[i]]
            if sum(new) <= spec.capacity and len(new) <= spec.max_documents and (len(new) == 1 or sum(x * x for x in new) <= spec.max_attention):
                rest = list(bins)
                rest.remove(list(b))
                place(i + 1, [*rest, new])
        place(i + 1, [*bins, [lengths[i]]])

    place(0, [])
    return best


def test_bins_against_the_fewest_possible():
    rng = np.random.default_rng(7)
    over = 0
    for trial, (docs, attention) in enumerate(itertools.product((2, 3, 9), (700, 2600, 10_000))):
        for rule in ("norm", "dot"):
            spec = packing.PackSpec(capacity=50, max_documents=docs, max_attention=attention, rule=rule)
            for _ in range(6):
                lengths = rng.integers(1, 26, 8)
                bins, _ = packing.pack(lengths, spec)
                found, best = len(np.unique(bins)), fewest(sorted(map(int, lengths), reverse=True), spec)
                assert best <= found <= best + 1, (trial, rule, lengths)
                over += found - best
    assert over <= 0.15 * 9 * 2 * 6
