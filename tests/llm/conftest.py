from __future__ import annotations

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()

#: Documents with everything that operators must stand: nulls, blanks, copies, one key twice, a very long text.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, size string, score string, y int, tokens string"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", "."]) + str(r.randint(0, 99)) * (r.random() < 0.1) for _ in range(n))


def row(i, text, lang="en", source="src1"):
    return (i, text, lang, source, len(text or ""), 1, 2, "s", "x", 3, "t")


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(4)
    base = [prose(r, r.randint(20, 200)) for _ in range(30)]
    rows = [row(i, t, r.choice(["en", "fr", None]), f"src{i % 6}") for i, t in enumerate(base)]
    rows += [row(100 + i, base[0]) for i in range(6)]
    rows += [row(200 + i, base[1].replace(" ", "  ", 1) + f" tail{i}") for i in range(8)]
    rows += [row(300, None), row(301, ""), row(302, " \t\n "), row(303, "one"), row(304, "one two three"), row(305, "One TWO three"), row(306, None, None, None)]
    rows += [row(7, base[7]), row(None, "a text without a key " * 4), row(400, prose(r, 20_000))]
    return rows


@pytest.fixture()
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
