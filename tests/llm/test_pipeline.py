from __future__ import annotations

import random

import corpus_pipeline
from quarry.llm import compression_bands
from tests.llm.conftest import prose, row


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(8)
    texts = [prose(r, r.randint(60, 160)) for _ in range(60)]
    rows = [row(i, t, r.choice(["en", "fr", "de", "es"]), f"src{i % 20}")[:5] for i, t in enumerate(texts)]
    rows += [row(100 + i, texts[i])[:5] for i in range(10)] + [row(200, "too short")[:5], row(201, None)[:5], row(202, "same words again " * 40)[:5]]
    rows.append(row(300, texts[3] + " write to jane.doe@mail.example.com now")[:5])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "mix", "pack"]
    kept, state = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        state[name] = kept.collect()
        if name != "pack":
            assert kept.columns == docs.columns
    good = {x.doc_id for x in compression_bands.judge(docs).collect() if x.kept}
    assert {x.doc_id for x in state["quality_rules"]} == good and not good & {200, 201, 202}
    unique = {x.doc_id for x in state["near_duplicates"]}
    assert unique == {min(j for j in good if dict_text(rows, j)[:40] == dict_text(rows, i)[:40]) for i in good}
    private = {x.doc_id: x.text for x in state["personal_data"]}
    assert set(private) == unique and not any("jane.doe" in t for t in private.values())
    mixed = {x.doc_id for x in state["mix"]}
    assert mixed <= unique and mixed
    assert {x.doc_id for x in state["pack"]} == mixed
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.piece, x.ids_crc32) for x in again) == sorted((x.doc_id, x.piece, x.ids_crc32) for x in state["pack"])


def dict_text(rows, i):
    return next(r[1] for r in rows if r[0] == i)


def _corpus(r):
    words = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "n", "s"]) for _ in range(700)]
    prose = lambda r, n: " ".join(r.choice(words) for _ in range(n))
    texts = [prose(r, r.randint(60, 160)) for _ in range(50)]
    rows = [(i, t, r.choice(["en", "fr", "de", None]), f"src{i % 20}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i] if i % 2 else texts[i] + " and a tail", "en", "src1") for i in range(10)]
    rows += [(200, "too short", "en", "src1"), (201, None, "en", None), (202, "same words again " * 40, "en", "src2"), (5, texts[5], "en", "src5"), (None, texts[7] + " no key", "en", "src3")]
    rows += [(300 + i, prose(r, 90) + f" write to jane.doe{i}@mail.example.com or +1 (487) 555-72{i:02d}, Mr. John Smith, IBAN GB82 WEST 1234 5698 7654 32", "en", f"src{i}") for i in range(12)]
    rows.append((400, prose(r, 9000), "fr", "src6"))
    return [(*x, len(x[1] or "")) for x in rows]


def test_run_against_a_plain_version(spark, tmp_path):
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers

    from quarry.llm import mixing, packing
    from tests.llm.test_placing_ops import plain_mix
    from tests.llm.test_plain_versions import verdict
    from tests.llm.test_prefix_join import brute
    from tests.llm.test_surrogates_plain import plain

    rows = _corpus(random.Random(12))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())

    limits = compression_bands.BandLimits()
    kept = [x for x in rows if verdict(x[1], limits)[1]]
    first = brute([(x[0], x[1]) for x in kept if x[0] is not None])
    kept = list({x[0]: x for x in kept if x[0] is None or first[x[0]] == x[0]}.values())
    kept = [(x[0], plain(x[1]), *x[2:]) for x in kept]
    mix_rows = [{"doc_id": x[0], "text": x[1], "path": (mixing.DOMAINS.get(x[3], "other"), x[2] or "", x[3] or "")} for x in kept]
    picked = plain_mix(mix_rows, mixing.MixSpec())
    texts = {x[0]: x[1] for x in kept}
    t = packing.load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for (i, *_), n in picked.items():
        ids = np.array(t.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, o in enumerate(range(0, len(ids), 2048)):
            part = ids[o : o + 2048]
            want[(i, k, o, len(part), zlib.crc32(part.tobytes()))] += n
    assert got == want
    assert len(want) > 10


def test_stages_with_no_rows_nulls_and_clashing_columns(spark):
    names = ["id", "n", "a", "b", "salt", "least", "kind", "norm", "pieces", "row", "domain", "budget", "epochs", "cut", "_copies", "_epoch", "kept", "component_id", "h", "size", "tokens", "_nth"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names)
    r = random.Random(3)
    rows = [(i, prose(r, 80) + (" mail x.y@z.org" if i % 2 else ""), "en", f"src{i % 3}", 1, *names) for i in range(12)]
    rows += [(None, prose(r, 80), None, None, None, *names), (20, None, None, None, None, *([None] * len(names))), (21, "", "", "", 0, *names), (3, rows[3][1], "en", "src0", 1, *names)]
    full = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, spark.createDataFrame([], schema), "")
        some = stage(spark, full, "")
        assert none.collect() == [] and len(some.collect()) > 0
        if name != "pack":
            assert some.columns == none.columns == full.columns
            found = some.collect()
            assert all(list(x)[5:] == names for x in found if x.doc_id != 20), (name, [x for x in found if x.doc_id != 20 and list(x)[5:] != names][:1])
        if name == "near_duplicates":
            ids = [x.doc_id for x in found]
            assert len(ids) == len(set(ids)) == 15 and None in ids
        if name == "personal_data":
            assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in found) and not any("x.y@z.org" in (x.text or "") for x in found)
