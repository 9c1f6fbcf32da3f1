"""Token alignment, integer clustering and Golay hashing against plain versions that share no code with them."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quarry.llm import block_norms, golay_hash, token_alignment
from tests.llm.conftest import SCHEMA, prose, row

# --- op11


def _plain_tokens():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    codes = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    chars = {chr(c): c for c in codes}
    for n, c in enumerate(c for c in range(256) if c not in codes):
        chars[chr(256 + n)] = c

    def of_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(chars[c] for c in a.id_to_token(i)) for i in ids]

    def of_b(text):
        ids = b.encode(text)
        return ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return of_a, of_b


def plain_alignment(texts):
    of_a, of_b = _plain_tokens()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        (ia, ba), (ib, bb) = of_a(t), of_b(t)
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            docs.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        ea, eb = (np.cumsum(list(map(len, x))).tolist() for x in (ba, bb))
        both = sorted(set(ea) & set(eb))
        ga, gb = ([[] for _ in both] for _ in "ab")
        for ids, at, groups in ((ia, ea, ga), (ib, eb, gb)):
            g = 0
            for i, e in zip(ids, at):
                while both[g] < e:
                    g += 1
                groups[g].append(i)
        docs.append((len(ia), len(ib), ga, gb))
    held = Counter()
    for d in docs:
        if d:
            held.update({(x, y) for p, q in zip(d[2], d[3]) for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for p, q in zip(d[2], d[3]) for x in p for y in q]
        listing = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in zip(d[2], d[3]))
        out.append((d[0], d[1], len(d[2]), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(listing.encode()).hexdigest()))
    return out


ODD_TEXTS = [
    "plain words, and <|endoftext|> </s> <s> <unk> <0x41> inside",
    "two  spaces\n\n\ttabs\r\nand   no-break \u0085 \x1c end ",
    " leading and trailing  ",
    "naïve café ßþāłɉ ǅ it's WE'LL ²½ª",
    "你好世界 こんにちは \U0001f600\U0001f468‍\U0001f469 Здравствуй",
    "a ▁ block that stands for a space",
    "nul \x00 inside",
    "x" * 5000 + " " * 3000 + "y" * 10,
    "é combining İı",
    "a",
    " ",
]


def test_alignment_against_a_plain_version(spark, odd_rows):
    r = random.Random(9)
    rows = [(q[0], q[1]) for q in odd_rows] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(2000 + i, "".join(chr(r.choice([r.randrange(32, 127), 32, 32, r.randrange(0x250), r.randrange(0x2000)])) for _ in range(200))) for i in range(60)]
    docs = spark.createDataFrame([row(*x) for x in rows], SCHEMA).repartition(3)
    spec = token_alignment.AlignSpec(part_bytes=3000, block_bytes=20_000, products=50)  # many parts, blocks and slices of links
    want = sorted(zip([str(i) for i, _ in rows], plain_alignment([t for _, t in rows])))
    for s in (spec, token_alignment.AlignSpec(), token_alignment.AlignSpec(ranks=None)):
        got = token_alignment.alignment_figures(docs, spec=s).collect()
        assert sorted((str(g[0]), tuple(g[1:])) for g in got) == want


def test_groups_and_overlaps_put_a_text_back(spark):
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, None, "", "some words of a text"])]
    got = token_alignment.aligned_groups(spark.createDataFrame([row(*x) for x in rows], SCHEMA)).collect()
    of_a, of_b = _plain_tokens()
    for i, t in rows:
        groups = sorted((g for g in got if g.doc_id == i), key=lambda g: g.nth)
        if not groups:
            assert not t or "▁" in t
            continue
        assert [x for g in groups for x in g.a_ids] == of_a(t)[0] and [x for g in groups for x in g.b_ids] == of_b(t)[0]
        assert [g.nth for g in groups] == list(range(len(groups)))
        assert [g.start for g in groups] == [0, *(g.end for g in groups[:-1])] and groups[-1].end == len(t.encode()) + 1
        assert all(g.overlaps[-1].end == g.end for g in groups)
        ends_a, ends_b = (np.cumsum(list(map(len, f(t)[1]))).tolist() for f in (of_a, of_b))
        flat = [o for g in groups for o in g.overlaps]
        assert [o.end for o in flat] == sorted(set(ends_a) | set(ends_b))
        for o in flat:
            assert ends_a[o.a] >= o.end and (o.a == 0 or ends_a[o.a - 1] < o.end)
            assert ends_b[o.b] >= o.end and (o.b == 0 or ends_b[o.b - 1] < o.end)


def test_alignment_of_nothing(spark, no_docs):
    assert token_alignment.alignment_figures(no_docs).collect() == []
    only = spark.createDataFrame([row(1, None), row(2, ""), row(None, "▁")], SCHEMA)
    assert {tuple(r)[1:] for r in token_alignment.alignment_figures(only).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_one_group_of_many_tokens(spark):
    aligner = token_alignment.Aligner.of(*token_alignment._aligner(token_alignment.AlignSpec()))
    g = aligner.align([("\U0001f600" * 300).encode()])
    every = aligner.links(g, 10**9)
    for few in (1, 7, 100):
        assert all((x == y).all() for x, y in zip(every, aligner.links(g, few)))


def test_fast_and_slow_tokens_agree():
    paths = token_alignment._aligner(token_alignment.AlignSpec())
    fast, slow = token_alignment.ByteTokenizer(paths[0], paths[2]), token_alignment.ByteTokenizer(paths[0], None)
    r = random.Random(2)
    texts = ["".join(chr(c) for c in range(0x250)), " ".join(chr(c) for c in range(0x250)), "a".join(chr(c) for c in range(0x250)), "1 ".join(chr(c) for c in range(0x250))]
    texts += ["".join(chr(r.choice([32, 10, 39, r.randrange(0x250), r.randrange(97, 123)])) for _ in range(300)) for _ in range(400)]
    for t in texts:
        assert fast.encode(t, t.encode()).tolist() == slow.encode(t, t.encode()).tolist()


# --- op12


def plain_clusters(rows, spec):
    kept = [(i, [int(np.floor(np.float64(spec.scale) * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == spec.dims and all(c is not None and np.isfinite(c) for c in v)]
    hashed = sorted(((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~"), v) for i, v in kept)
    cents = [v for _, v in hashed[: spec.centroids]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(spec.rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        cents = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    found = [(i, *near(v)) for i, v in kept]
    per = Counter()
    for _, d, j in found:
        per[j] += d
    total = sum(per.values())
    return sorted((str(i), j, d, per[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in found)


def odd_vectors(seed, n=300, dims=64):
    r = np.random.default_rng(seed)
    rows = [(int(i), (r.normal(size=dims) * r.choice([0.1, 1, 5])).astype(np.float32).tolist()) for i in range(n)]
    rows += [(i, rows[i][1]) for i in range(20)]  # repeated rows
    rows += [(3, rows[5][1]), (None, rows[6][1]), (1001, [0.0] * dims), (1002, [0.0] * dims), (1003, None), (1004, [1.0] * (dims - 1)), (1005, [None] + [1.0] * (dims - 1))]
    rows += [(1006, [float("nan")] + [1.0] * (dims - 1)), (1007, [float("inf")] + [1.0] * (dims - 1)), (1008, []), (1009, [-0.5 / 256] * dims), (1010, [20_000.5] * dims)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, x string, norms int, cluster string, distance string, key int"


@pytest.mark.parametrize("spec", [block_norms.ClusterSpec(), block_norms.ClusterSpec(centroids=3, rounds=2, blocks=5), block_norms.ClusterSpec(centroids=500, rounds=1, blocks=64)])
def test_clusters_against_a_plain_version(spark, spec):
    rows = odd_vectors(3)
    df = spark.createDataFrame([(i, v, 1, "x", 2, "c", "d", 3) for i, v in rows], VECTORS).repartition(3)
    got = block_norms.cluster(df, spec=spec).collect()
    assert sorted((str(g.vec_id), *tuple(g)[1:6]) for g in got) == plain_clusters(rows, spec)
    assert all(hashlib.sha256(",".join(map(str, g.centroid)).encode()).hexdigest() == g.centroid_sha256 for g in got)


def test_clusters_of_nothing(spark):
    assert block_norms.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert block_norms.cluster(spark.createDataFrame([(1, None, 1, "x", 2, "c", "d", 3)], VECTORS)).collect() == []


def test_equal_vectors_fall_to_the_first_centroid(spark):
    df = spark.createDataFrame([(i, [1.0] * 64, 1, "x", 2, "c", "d", 3) for i in range(60)], VECTORS)
    assert {(g.cluster, g.distance) for g in block_norms.cluster(df).collect()} == {(0, 0)}


def test_bounds_are_never_above_distances_and_spare_work():
    r = np.random.default_rng(5)
    spec = block_norms.ClusterSpec()
    c = r.integers(-4000, 4000, (40, 64)) * r.integers(0, 2, (40, 64))
    x = c[r.integers(0, 40, 2000)] + r.integers(-200, 200, (2000, 64))
    nx, nc = block_norms.block_norms(x, spec), block_norms.block_norms(c, spec)
    exact = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (block_norms.lower_bounds(nx, nc) <= exact).all()
    cluster, least, measured = block_norms.nearest(x, nx, c, nc)
    assert (cluster == exact.argmin(1)).all() and (least == exact.min(1)).all()
    assert measured < 0.1 * exact.size


def test_components_that_no_long_can_measure_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        block_norms.cluster(spark.createDataFrame([(1, [1e30] * 64, 1, "x", 2, "c", "d", 3)], VECTORS)).collect()


# --- op13


def plain_print(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in "\t\n\r\x0b\x0c":
        t = t.replace(s, " ")
    words = [w for w in t.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, prints):
    """Components of distinct fingerprints by all pairs."""
    nodes = sorted(set(prints))
    up = {p: p for p in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                links.add((a, b))
                up[top(a)] = top(b)
    least = {}
    for (i, *_), p in zip(rows, prints):
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return links, [least.get(top(p)) for p in prints]


def test_golay_tables():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 3000)
    index, n = golay_hash.nearby(words)
    assert set(n.tolist()) == {1, 6} and abs((n == 6).mean() - 1771 / 2048) < 0.03
    one = words ^ (1 << r.integers(0, 23, 3000))
    other = golay_hash.nearby(one)[0]
    assert all(o[0] in set(i[:k]) for i, k, o in zip(index, n, other))  # one bit apart: the nearest of one is nearby the other
    two = one ^ (1 << r.integers(0, 23, 3000))
    others = golay_hash.nearby(two)
    assert all(set(i[:k]) & set(o[:m]) for i, k, o, m in zip(index, n, *others))  # two bits apart: a common index
    assert all(len(set(i[:k].tolist())) == k for i, k in zip(index, n))


def _pairs(spark, prints, tmp, **spec):
    from quarry.runtime import Workspace

    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(set(prints))]
    nodes = spark.createDataFrame([(p,) for p in signed], "print long")
    got = {(r.a, r.b) for r in golay_hash.links(Workspace(spark, tmp), nodes, golay_hash.HashSpec(**spec)).collect()}
    return {tuple(sorted((a % (1 << 64), b % (1 << 64)))) for a, b in got}


def test_no_link_is_lost_in_sparse_and_crowded_fingerprints(spark):
    r = random.Random(8)
    prints = [r.getrandbits(64) for _ in range(100)]
    for p in prints[:40]:
        for _ in range(4):
            prints.append(p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    for _ in range(600):  # a crowd around one fingerprint
        prints.append(prints[0] ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}))
    want, _ = plain_components([(None,)] * len(prints), prints)
    want = {tuple(sorted(x)) for x in want}
    assert len(want) > 500
    for bucket in (1, 8, 64, 10**9):
        assert _pairs(spark, prints, "t", bucket_rows=bucket) == want


def test_near_duplicates_against_all_pairs(spark, odd_rows):
    r = random.Random(3)
    rows = list(odd_rows)
    base = prose(r, 400)
    for i in range(150):
        words = base.split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            words[r.randrange(400)] = f"edit{i}"
        rows.append(row(1000 + i, " ".join(words)))
    rows += [row(5000 + i, base) for i in range(200)]  # one text, many copies
    prints = [plain_print(q[1]) for q in rows]
    _, want = plain_components(rows, prints)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for spec in (None, golay_hash.HashSpec(bucket_rows=2)):
        got = golay_hash.near_duplicates(docs, spec=spec).collect()
        expect = sorted(str((q[0], f"{p:016x}", c)) for q, p, c in zip(rows, prints, want))
        assert sorted(str(tuple(g)) for g in got) == expect
    links, members = golay_hash.linked_pairs(docs)
    assert members.count() == len(rows) and links.where("bits > 2 or a >= b").isEmpty()


def test_fingerprints_of_nothing(spark, no_docs):
    assert golay_hash.near_duplicates(no_docs).collect() == []
    got = golay_hash.near_duplicates(spark.createDataFrame([row(None, "a b c d"), row(5, None), row(4, "")], SCHEMA)).collect()
    assert {tuple(g)[0]: g.component_id for g in got} == {None: None, 5: 4, 4: 4} and {g.fingerprint for g in got if g.doc_id} == {"0" * 16}


def test_blocks_are_written_in_small_rows(spark):
    docs = spark.createDataFrame([row(i, f"words {i} of document {i * 7919} with pairs {i * 31}") for i in range(300)], SCHEMA).coalesce(1)
    spec = token_alignment.AlignSpec(run=100)
    rows = token_alignment._blocks(docs, "doc_id", "text", spec).collect()
    assert sorted(r["id"] for r in rows if r["hash"] is not None) == list(range(300))
    runs = [r for r in rows if r["hash"] is None]
    assert len(runs) > 1 and all(len(r["pairs"]) <= 100 for r in runs)
    assert [r["at"] for r in runs] == [100 * i for i in range(len(runs))]
