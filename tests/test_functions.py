from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import scoring, text, vector


def one(spark, *cols):
    r = spark.range(1).select(*cols).first()
    return r[0] if len(cols) == 1 else tuple(r)


def values(spark, f, inputs):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r[1] for r in rows.select("i", f(F.col("x"))).orderBy("i").collect()]


def test_truncate(spark):
    assert values(spark, lambda x: text.truncate(x, 3, "..."), ["abcdef", None, "abc", ""]) == ["abc...", "", "abc", ""]
    assert values(spark, lambda x: text.truncate(x, -1, "..."), ["abcdef"]) == ["abcdef"]


def test_keys_and_tokens(spark):
    assert values(spark, text.norm_key, ["\t Lung \n", None]) == ["lung", None]
    assert values(spark, text.tokens, ["  A b\n\tC ", "", None]) == [["a", "b", "c"], [], []]
    assert values(spark, lambda x: text.after(x, "="), ["a = b = c", "plain "]) == ["b = c", "plain"]


def test_ids_and_sizes(spark):
    assert values(spark, text.sample_id, ["x_gsm12_y", "none"]) == ["GSM12", "NA"]
    assert values(spark, text.series_ids, ["GSE2 GSE10 gse3 GSE2"]) == [["GSE10", "GSE2"]]
    sizes = [0, 1, 1023, 1024, 1536, 5 * 1024**3, 3 * 1024**5]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(sizes)), "i int, n long").select("i", text.format_bytes(F.col("n"))).orderBy("i").collect()]
    assert got == ["0 B", "1.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "5.0 GB", "3072.0 TB"]
    assert one(spark, text.format_gb(F.lit(0.5)), text.format_gb(F.lit(2.0))) == ("512 MB", "2.0 GB")
    assert values(spark, text.first_number, ["P42 weeks 7", "adult"]) == [42, None]


def test_json_text(spark):
    cases = {
        '```json\n{"a": 1}\n```': {"a": 1},
        '{"a": {"b": "}"}} tail }': {"a": {"b": "}"}},
        'well {"a": "quo\\"te {"} end': {"a": 'quo"te {'},
        "no json": None,
        "{broken": None,
        "```\nnot json\n``` but {\"a\": 2}": {"a": 2},
        "": None,
    }
    got = values(spark, text.json_text, list(cases))
    assert [json.loads(g) if g else None for g in got] == list(cases.values())


def test_failures(spark):
    assert values(spark, text.failure_class, ["Read timeout", "CUDA out of memory", "x", None]) == ["timeout", "oom", "error", "error"]
    assert one(spark, text.failure_class(F.lit("500"), F.lit("HTTPError"))) == "http_error"


def test_mcq_letters(spark):
    cases = {"B) because": "B", "The answer is c": "C", "none": "", " A ": "A", "Apple": "", "so it is D": "D", "correct: b.": "B", None: ""}
    assert values(spark, scoring.mcq_letter, list(cases)) == list(cases.values())


def test_numbers(spark):
    cases = {"#### 1,234": "1234", "3 then 5": "5", "no": "", "#### 3.50 or 7": "3.50", None: ""}
    assert values(spark, scoring.number, list(cases)) == list(cases.values())


def test_readers(spark):
    assert values(spark, scoring.says_yes, ["Yes it is", "well I say yes", "no"]) == [True, False, False]
    assert values(spark, scoring.decision, ["Yes.", "No way", "unclear", "I would think that no"]) == ["yes", "no", "maybe", "maybe"]
    assert values(spark, scoring.has_call, ["f(x)", "<tool_call>", '{"name": 1}', "plain"]) == [True, True, True, False]


def plain_f1(p, g):
    p, g = set(p.lower().split()), set(g.lower().split())
    if not p and not g:
        return 1.0
    both = len(p & g)
    return 2 * both / (len(p) + len(g)) if p and g else 0.0


def test_token_f1(spark):
    pairs = [("", ""), ("a", ""), ("", "b"), ("a b c", "B c d"), ("x", "y"), ("a a a", "a")]
    got = [r[1] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string").select("i", scoring.token_f1(F.col("p"), F.col("g"))).orderBy("i").collect()]
    assert got == pytest.approx([plain_f1(*p) for p in pairs])


@settings(max_examples=15, deadline=None)
@given(a=st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3), b=st.lists(st.floats(-5, 5, width=32), min_size=3, max_size=3))
def test_cosine_is_symmetric_and_bounded(spark, a, b):
    x, y = one(spark, vector.cosine(vector.constant(a), vector.constant(b)), vector.cosine(vector.constant(b), vector.constant(a)))
    assert x == pytest.approx(y) and abs(x) <= 1 + 1e-9


def test_zero_vector(spark):
    assert one(spark, vector.cosine(vector.constant([0.0, 0.0]), vector.constant([1.0, 0.0]))) == 0.0
