"""Surrogates against a plain Python version, and a fuzzed table of formats."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import regex

from quarry.llm import surrogates
from tests.llm.conftest import SCHEMA, row



def ascii_digits(pattern):
    """The pattern with \\d written out, which means ASCII digits on the JVM."""
    inside = False
    out = []
    for x in regex.findall(r"\\.|.", pattern, regex.S):
        inside = x == "[" or inside and x != "]"
        out.append(("0-9" if inside else "[0-9]") if x == r"\d" else x)
    return "".join(out)


MENTION = regex.compile(ascii_digits(surrogates.MENTION))
SPEC = surrogates.SurrogateSpec()
SKIP = regex.compile(f"(?:{surrogates._TITLES}|{surrogates._LABELS}|{surrogates._INITIAL}|{surrogates._PARTICLE})")
COUNTRY = regex.compile(ascii_digits(rf"\+({surrogates._COUNTRY})"))


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10


def kind_of(m):
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    for kind, pattern in (
        ("email", ".*@.*"),
        ("ip6", "[0-9A-Fa-f:]*:[0-9A-Fa-f:]*"),
        ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("ip", rf"{octet}(?:\.{octet}){{3}}"),
        ("phone", rf"[+(].*|\d{{3}}[\-.]\d{{3}}[\-.]\d{{4}}|{surrogates._NATIONAL}"),
        ("iban", r"[A-Z]{2}\d{2}[ A-Z0-9]+"),
        ("card", r"\d.*"),
    ):
        if regex.fullmatch(pattern, m, regex.A):
            return kind
    return "name"


def norm_of(kind, m):
    d = digits(m)
    if kind in ("email", "ip6"):
        return m.lower()
    if kind == "ip":
        return m
    if kind == "iban":
        return m.replace(" ", "")
    if kind != "phone":
        return d
    if m[0] == "+":
        code = COUNTRY.match(m)[1]
        rest = d[len(code) :]
        return f"{code}-{rest[1:] if rest[:1] == '0' else rest}"
    if regex.fullmatch(r"0[1-9](?:[ .\-]?\d{2}){4}", m, regex.A):
        return "33-" + d[1:]
    if m[0] == "0" and not regex.fullmatch(r"\d{3}[\-.]\d{3}[\-.]\d{4}", m, regex.A):
        return "0-" + d[1:]
    return "34-" + d if len(d) == 9 else "1-" + d[-10:]


def word_kind(w):
    script = "cyrillic" if regex.search(r"\p{IsCyrillic}", w) else "greek" if regex.search(r"\p{IsGreek}", w) else "latin"
    groups = [g for g, names in surrogates.GIVEN.items() if w.lower() in {n.lower() for n in names}]
    return f"name:{groups[-1]}" if groups else f"name:{script}"


def digest(kind, norm, attempt, part):
    return hashlib.sha256("|".join((SPEC.key, part, kind, norm, str(attempt))).encode()).hexdigest()


def stream(h):
    return h.translate(str.maketrans("abcdef", "012345"))


def surrogate(kind, norm):
    one, two = digest(kind, norm, 0, "1"), digest(kind, norm, 0, "2")
    ds = stream(one) + stream(two)
    letters = two.translate(str.maketrans("0123456789", "ghijklmnop"))
    number = lambda i: int(one[6 * i : 6 * i + 6], 16)
    if kind == "email":
        local, domain = norm.split("@")
        new = []
        for i, c in enumerate(local):
            x = letters[i % 64]
            cyr = x.translate(str.maketrans("abcdefghijklmnop", "абвгдежзиклмнопр"))
            new.append(cyr if regex.match(r"\p{IsCyrillic}", c) else x if c.isalpha() else ds[i % 64] if c in "0123456789" else c)
        return "".join(new) + ds[69:75] + "@mail" + stream(digest("domain", domain, 0, "3"))[:6] + ".example." + domain.split(".")[-1]
    if kind == "ip":
        return ".".join(str(number(i) % n + low) for i, (low, n) in enumerate(((1, 223), (0, 256), (0, 256), (1, 254))))
    if kind == "ip6":
        return "".join(c if c == ":" else one[i : i + 1].replace("0", "f") for i, c in enumerate(norm))
    if kind == "phone":
        code, n = norm.split("-")
        first = ds[0].translate(str.maketrans("01", "29"))
        if code == "34":
            first = first.translate(str.maketrans("2345", "6789"))
        fourth = ds[3].translate(str.maketrans("01", "29")) if code == "1" else ds[3]
        return f"{code}-{(first + ds[1:3] + fourth + ds[4:])[: len(n)]}"
    if kind == "ssn":
        area = number(0) % 898 + 1
        return f"{area + (area >= 666):03d}{number(1) % 99 + 1:02d}{number(2) % 9999 + 1:04d}"
    if kind == "iban":
        body = "".join(ds[2 + i] if c in "0123456789" else letters[i].upper() for i, c in enumerate(norm[4:]))
        right = 98 - mod97(norm[:2] + "00" + body)
        return f"{norm[:2]}{right if mod97(norm) == 1 else right % 97 + 1:02d}{body}"
    if kind == "card":
        body = ds[: len(norm) - 1]
        right, last = (10 - luhn(body + "0")) % 10, int(ds[len(norm) - 1])
        return body + str(right if luhn(norm) == 0 else (right + 1) % 10 if last == right else last)
    group = kind[5:]
    if group in surrogates.GIVEN:
        return surrogates.given_surrogates(SPEC, group)[norm]
    return "".join(surrogates._SYLLABLES[group][int(c, 16)] for c in one[:5])


def fill(shape, chars, which):
    it = iter(chars)
    return "".join(next(it) if which(c) else c for c in shape)


def replaced(m):
    kind = kind_of(m)
    if kind == "name":
        out = []
        for w in m.split(" "):
            if SKIP.fullmatch(w):
                out.append(w)
                continue
            s = surrogate(word_kind(w), w.lower())
            out.append(s.upper() if w == w.upper() and len(w) > 1 else s if w == w.lower() else s[0].upper() + s[1:].lower())
        return " ".join(out)
    norm = norm_of(kind, m)
    s = surrogate(kind, norm)
    if kind == "phone":
        lead = COUNTRY.match(m)[0] if m[0] == "+" else ""
        rest, n = m[len(lead) :], s.split("-")[1]
        return lead + fill(rest, digits(rest)[: len(digits(rest)) - len(n)] + n, str.isdigit)
    if kind in ("card", "ssn"):
        return fill(m, s, str.isdigit)
    if kind == "iban":
        return fill(m, s, lambda c: c != " ")
    return s.upper() if kind in ("email", "ip6") and m.upper() == m else s


def plain(text):
    return None if text is None else MENTION.sub(lambda m: replaced(m[0]), text)


def formats(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    n1 = lambda n: r.choice("23456789") + d(n - 1)
    group = lambda s, k=4: " ".join(s[i : i + k] for i in range(0, len(s), k))
    body = f"{d(4)}{d(14)}"
    iban = f"GB{98 - mod97('GB00WEST' + body[:14]):02d}WEST{body[:14]}"
    given = r.choice([n for g in ("latin:f", "latin:m") for n in surrogates.GIVEN[g]])
    return [
        f"+1415{n1(7)}", f"+4420{n1(8)}", f"+49 30 {n1(7)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"+44 (0)20 {n1(4)} {d(4)}", f"+351 {n1(3)} {d(3)} {d(3)}", f"+7 {n1(3)} {d(3)}-{d(2)}-{d(2)}",
        f"({n1(3)}) {n1(3)}-{d(4)}", f"{n1(3)}-{n1(3)}-{d(4)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"030 {n1(7)}", f"020 {n1(4)} {d(4)}", f"612 {d(3)} {d(3)}", f"+34 612 {d(3)} {d(3)}",
        f"{n1(3)}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", iban, group(iban), f"DE{d(2)} {group(d(18))}", group(f"4{d(15)}"), f"4{d(15)}",
        f"{r.randint(1, 223)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)}", f"2001:db8:{r.randint(1, 9)}::{r.randint(1, 99)}", f"fe80:0:0:0:{d(3)}:2:3:{d(2)}",
        f"o'neil-{d(3)}@ex{d(2)}.co.uk", f"ÉMILIE.{d(2)}@CORP.COM", f"анна{d(2)}@почта.example.org" if r.random() < 0.2 else f"a_b{d(4)}@mail.example.org",
        f"Mr. John {r.choice(['Smith', 'Tanaka', 'O’Hara', 'McGill'])}", f"{given} van der {r.choice(['Berg', 'Meer'])}", f"Name: {given} Quist", "Г-жа Анна Кузнецова", "Κυρία Μαρία Παπαδοπούλου",
    ]


def test_against_plain_version(spark, odd_rows):
    r = random.Random(3)
    rows = list(odd_rows)
    for i in range(40):
        parts = formats(r)
        r.shuffle(parts)
        rows.append(row(1000 + i, " ; ".join(parts[: r.randint(1, 12)]) + r.choice(["", ".", " end", "\n"])))
    rows += [row(2000, "long " * 30_000 + "mail a@b.co " + "words " * 30_000), row(2001, "mark  and c.d@e.org "), row(2002, "Name:")]
    got = surrogates.replace_entities(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    want = sorted(((x[0], plain(x[1])) for x in rows), key=key)
    for a, b in zip(sorted(((x.doc_id, x.text) for x in got), key=key), want, strict=True):
        assert a == b


def test_no_original_is_left_in_any_format(spark):
    r = random.Random(9)
    each = [(i, k, m) for i in range(60) for k, m in enumerate(formats(r))]
    rows = [row(1000 * i + k, f"so {m} then") for i, k, m in each]
    got = {x.doc_id: x for x in surrogates.replace_entities(spark.createDataFrame(rows, SCHEMA), count="n_mentions").collect()}
    new = {}
    for i, k, m in each:
        x = got[1000 * i + k]
        assert x.n_mentions == 1 and m not in x.text and x.text.startswith("so ") and x.text.endswith(" then"), (m, x.text)
        own = x.text[3:-5]
        kind = kind_of(m)
        if kind not in ("name", "email"):
            assert kind_of(own) == kind and [c for c in own if not c.isalnum()] == [c for c in m if not c.isalnum()], (m, own)
            assert new.setdefault((kind, norm_of(kind, m)), norm_of(kind, own)) == norm_of(kind, own)
        if kind == "iban":
            assert (mod97(own.replace(" ", "")) == 1) == (mod97(m.replace(" ", "")) == 1)
        if kind == "phone" and m[0] == "+":
            assert COUNTRY.match(m)[0] == COUNTRY.match(own)[0]
    assert not Counter((k, v) for (k, _), v in new.items()).most_common(1)[0][1] > 1


def test_forms_of_one_number_are_one_entity(spark):
    rows = [row(1, "+1 487 555 7209"), row(2, "(487) 555-7209"), row(3, "487.555.7209"), row(4, "+33 6 12 34 56 78"), row(5, "06 12 34 56 78"), row(6, "+33612345678"), row(7, "+34 612 345 678"), row(8, "612 345 678")]
    got = {x.doc_id: digits(x.text) for x in surrogates.replace_entities(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1][1:] == got[2] == got[3] and got[4] == got[6] and got[4][2:] == got[5][1:] and got[7][2:] == got[8]


def test_columns_with_clashing_names_and_collisions(spark, monkeypatch):
    from pyspark.sql import functions as F

    small = lambda spec, kind, norm, one, two: F.concat(F.lit("10.0.0."), (F.crc32(one.cast("binary")) % 40).cast("string"))
    monkeypatch.setattr(surrogates, "surrogate_norm", small)
    names = ["id", "_id", "of", "row", "pieces", "tries", "_attempts", "kind", "norm", "n"]
    df = spark.createDataFrame([(i, f"97.51.17.{i}", *range(10)) for i in range(30)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = surrogates.replace_entities(df, surrogates.SurrogateSpec(patience=2), count="found").collect()
    assert len({x.text for x in got}) == 30 and got[0].asDict().keys() == {*df.columns, "found"} and all(list(x)[2:12] == list(range(10)) for x in got)
