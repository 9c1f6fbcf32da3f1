"""Keyed surrogates for personal data.

Mentions of e-mail addresses, phone numbers, account and card numbers, social security numbers, IBANs, IP addresses
and names are found by one pattern and replaced by surrogates of the same kind. A surrogate depends on a secret key and
on the normalized entity only, so all mentions of an entity in all documents get the same one (coreference), in the
format of each mention: separators, country code, letter case, number of digits and a valid or invalid check digit stay.
National and international forms of an American, French or Spanish number are one entity. Given names are exchanged
inside lists of one gender and script, by a keyed permutation; other name words become made-up words of their script.

Distinctness is checked, not assumed: all distinct entities of the corpus get their surrogates, and of those that
collide with each other, or with an original of the same kind, all but one are drawn again with the next attempt until
no collision is left. Made-up words and numbers get longer with the attempts, so that this always ends. Only entities
whose attempt isn't 0 need a lookup when texts are rewritten; if there are none, texts are rewritten without a join.

A text is read by the pattern once for its entities and once for its new form: mentions are put between marks, at which
the text is split. A text that holds the mark itself is split by the pattern.

Main path: DataFrame functions only. Defined cases: null texts stay null; empty texts and texts without mentions stay as
they are; a text of any length is rewritten whole; repeated rows get equal texts; rows that share a doc_id are rewritten
alike; of entities that tie for a surrogate the one of the least attempt, then the least norm keeps it; an empty table
gives an empty result; all columns of the input stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.runtime import Workspace

#: Given names by script and gender, exchanged inside one list.
GIVEN = {
    "latin:f": "Alice Anna Barbara Carmen Catherine Charlotte Claire Elena Elizabeth Emily Emma Hannah Ingrid Isabella Jennifer Jessica Julia Karen Laura Linda Lucia Maria Margaret Martha Mary Nancy Olivia Patricia Rachel Rebecca Sarah Sofia Sophie Susan Ursula Abigail Adriana Agnes Alexandra Alicia Amanda Amelia Amy Ana Andrea Angela Anita Anja Anne Annette Ashley Audrey Beatrice Beatriz Birgit Brenda Brigitte Camille Caroline Cécile Céline Chantal Christina Christine Claudia Cristina Cynthia Deborah Denise Diana Diane Donna Dorothy Edith Eleanor Ellen Élise Emilia Émilie Erika Esther Eva Evelyn Florence Françoise Gabriele Gabriela Gertrud Gisela Gloria Grace Greta Heather Heidi Heike Helen Helena Helga Inés Irene Isabel Isabelle Jacqueline Jane Janet Jean Jessika Joan Joanna Josefina Joyce Juana Juliette Karin Katharina Katherine Kathleen Kelly Kimberly Kirsten Kristin Lauren Léa Lena Leonie Lisa Louise Lucy Luisa Manon Margarita Marie Marion Marta Martina Megan Melanie Melissa Mercedes Michelle Monica Monika Monique Nathalie Natalie Nicole Nina Pamela Paula Petra Pilar Renate Rosa Rosario Ruth Sabine Samantha Sandra Sara Sharon Shirley Silvia Simone Stefanie Stephanie Susanne Sylvie Teresa Theresa Valentina Valérie Vanessa Verónica Victoria Virginia Vivian Yolanda Yvonne Zoe".split(),
    "latin:m": "Alexander Andrew Antonio Charles Christopher Daniel David Edward Francisco Frank George Hans Henry Jacques James Javier John Joseph Juan Jürgen Kevin Klaus Luis Mark Matthew Michael Miguel Patrick Paul Peter Philip Pierre Richard Robert Stephen Thomas Walter William Wolfgang Aaron Adam Adrian Alain Alan Albert Alberto Alejandro Alfred Andreas Anthony Arnaud Arthur Austin Benjamin Bernard Bernd Brandon Brian Bruce Bruno Carl Carlos Christian Christoph Claude Craig Dennis Dieter Diego Dominik Donald Douglas Dylan Emilio Emmanuel Enrique Eric Ernst Ethan Étienne Eugene Fabian Felix Fernando Florian François Franz Frederick Friedrich Gabriel Gary Georg Gerald Gerhard Gérard Gilbert Gregory Guillaume Günter Harold Heinrich Heinz Helmut Henri Hermann Horst Hugo Ian Ignacio Isaac Jack Jacob Jan Jason Jean-Pierre Jeffrey Jeremy Jerry Jesse Jesús Jonas Jonathan Jorge Jose José Joshua Juergen Jules Julian Justin Karl Keith Kenneth Kurt Kyle Larry Lars Laurent Lawrence Leon Leonard Logan Louis Lucas Lukas Manfred Manuel Marc Marcel Marco Mario Markus Martin Mateo Mathieu Matthias Maurice Max Maximilian Michel Nathan Nicholas Nicolas Noah Olivier Oscar Otto Pablo Pascal Pedro Philipp Philippe Rafael Ralf Ralph Ramón Raymond Raúl Reinhard Roger Roland Ronald Russell Ryan Samuel Santiago Scott Sean Sebastian Sergio Simon Stefan Stephan Steven Sven Théo Thierry Timothy Tobias Uwe Victor Vincent Wayne Werner Wilhelm Xavier Yves Zachary".split(),
    "cyrillic:f": "Анна Екатерина Елена Ирина Людмила Мария Наталья Ольга Светлана Татьяна".split(),
    "cyrillic:m": "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Павел Сергей".split(),
    "greek:f": "Αικατερίνη Ελένη Ιωάννα Μαρία Σοφία".split(),
    "greek:m": "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
_SYLLABLES = {
    "latin": "bar ben dal dor fen gar hol kar lam mar nor pel ros sand tor win".split(),
    "cyrillic": "бар вол гор дол зор кол лен мир нов пет род сав тор фед хол яр".split(),
    "greek": "αλ βαρ γαλ δημ θεο καλ λαμ μαρ νικ παπ ραλ σταμ τζα φωτ χαρ ψαρ".split(),
}
_TITLES = r"(?:Mrs|Mr|Ms|Dr|Sra|Sr|Mme|Prof)\.|Miss|Herr|Frau|Monsieur|Madame|Señora|Señor|Г-жа|Г-н|Κύριος|Κυρία"
_WORD = r"\p{Lu}[\p{L}'’\-]+"
_LABELS = "(?:Name|Contact|Author|Patient|Employee|Customer|Nom|Auteur|Nombre|Autor|Kunde|Kundin|Ansprechpartner):"
_INITIAL = r"\p{Lu}\."
_PARTICLE = "(?:de|del|la|du|di|da|van|von|der|den|zu)"
_BY_LETTER: dict[str, list[str]] = {}
for _n in sorted({n for ns in GIVEN.values() for n in ns}, key=lambda n: (-len(n), n)):
    _BY_LETTER.setdefault(_n[0], []).append(_n[1:])
_ALL_GIVEN = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in sorted(_BY_LETTER.items()))  # by first letter, so that most words fail at once
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

_EMAIL = r"(?<![\p{L}\p{N}._%+'’\-])[\p{L}\p{N}_%+][\p{L}\p{N}._%+'’\-]*+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
_INTERNATIONAL = r"(?<![\d+])\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d(?=[ .\-]))?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|(?<![\d.\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-])"
#: National numbers: French pairs, German and British numbers with a leading 0, Spanish groups of a 9-digit number, and spaced American ones.
_NATIONAL = (
    r"0[1-9](?:[ .\-]?\d{2}){4}|(?=(?:[ /\-]?\d){8,13}(?![ .\-/]?\d))0[1-9]\d{1,4}[ /\-]\d{2,8}(?:[ \-]\d{2,5}){0,3}"
    r"|[6789]\d{2}(?:[ .\-]\d{3}){2}|[6789]\d{2}(?: \d{2}){3}|9\d \d{3} \d{2} \d{2}|(?:1[ \-.])?[2-9]\d{2}[ \-.]\d{3}[ \-.]\d{4}"
)
_PHONE = rf"{_INTERNATIONAL}|(?=\d)(?<![\p{{L}}\d.,+/_\-])(?:{_NATIONAL})(?![ .\-/]?\d)(?![\p{{L}}_])"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![\d.])\d{4}(?:[ \-]?\d{4}){2,3}(?:[ \-]?\d{1,3})?(?!\d)"
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:(?:{_TITLES}|{_LABELS}) {_WORD}(?: {_INITIAL})?(?: {_PARTICLE}){{0,2}}(?: {_WORD})?|(?:{_ALL_GIVEN})(?: {_INITIAL})?(?: {_PARTICLE}){{0,2}} {_WORD})"
#: A mention starts with a digit, + or bracket, or after something other than a letter; no other place is tried.
MENTION = r"(?=[\d+(]|(?<!\p{L}))(?:" + "|".join((_EMAIL, _SSN, _PHONE, _IP6, _IP, _IBAN, _CARD, _NAME)) + ")"
#: Country codes of E.164: two zones of one digit, the countries with two, and three for all others.
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_MARK = "\ue000"  # a character of private use


@dataclass(frozen=True)
class SurrogateSpec:
    key: str = "quarry-surrogates"
    patience: int = 4  #: attempts before a surrogate gets longer


def _digest(spec: SurrogateSpec, kind: Column, norm: Column, attempt: Column, part: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(spec.key), F.lit(part), kind, norm, attempt.cast("string")), 256)


def given_surrogates(spec: SurrogateSpec, group: str) -> dict[str, str]:
    """Each given name of a list -> the next one in the keyed order, all in lower case; none stays as it is."""
    order = sorted({n.lower() for n in GIVEN[group]}, key=lambda n: hashlib.sha256(f"{spec.key}|{group}|{n}".encode()).hexdigest())
    return dict(zip(order, [*order[1:], order[0]], strict=True))


def _digits_only(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def kind_of(m: Column) -> Column:
    """Kind of a whole mention; the alternatives are those of MENTION."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(m.rlike(rf"^(?:\+|\()|^\d{{3}}[\-.]\d{{3}}[\-.]\d{{4}}$|^(?:{_NATIONAL})$"), "phone")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban")
        .when(m.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def _phone_norm(m: Column) -> Column:
    """country code-national number without the trunk's 0; a code of 0 where the form doesn't tell the country."""
    digits = _digits_only(m)
    code = F.regexp_extract(m, rf"^\+({_COUNTRY})", 1)
    abroad = F.concat(code, F.lit("-"), F.regexp_replace(F.substring(digits, F.length(code) + 1, F.length(digits)), "^0", ""))
    return (
        F.when(m.startswith("+"), abroad)
        .when(m.rlike(r"^0[1-9](?:[ .\-]?\d{2}){4}$"), F.concat(F.lit("33-"), F.substring(digits, 2, 15)))
        .when(m.startswith("0") & ~m.rlike(r"^\d{3}[\-.]\d{3}[\-.]\d{4}$"), F.concat(F.lit("0-"), F.substring(digits, 2, 15)))
        .when(F.length(digits) == 9, F.concat(F.lit("34-"), digits))
        .otherwise(F.concat(F.lit("1-"), F.right(digits, F.lit(10))))
    )


def _norm(kind: Column, m: Column) -> Column:
    """What two mentions of one entity have in common."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "phone", _phone_norm(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(_digits_only(m))
    )


def name_kind(word: Column) -> Column:
    """name:script:gender for known given names, name:script for other words."""
    k = F.lit("name:latin")
    k = F.when(word.rlike(r"\p{IsCyrillic}"), "name:cyrillic").when(word.rlike(r"\p{IsGreek}"), "name:greek").otherwise(k)
    for group, names in GIVEN.items():
        k = F.when(F.lower(word).isin([n.lower() for n in names]), f"name:{group}").otherwise(k)
    return k


def parts_of(mentions: Column) -> Column:
    """Array of arrays of struct(text, kind, norm): a name has a part per word, titles without a kind; others have one.

    Each step names what the next one uses, so that no expression is repeated in the plan.
    """
    typed = F.transform(mentions, lambda m: F.struct(m.alias("text"), kind_of(m).alias("kind")))

    def word(w: Column) -> Column:
        kind = F.when(~w.rlike(rf"^(?:{_TITLES}|{_LABELS}|{_INITIAL}|{_PARTICLE})$"), name_kind(w))
        return F.struct(w.alias("text"), kind.alias("kind"), F.lower(w).alias("norm"))

    def parts(x: Column) -> Column:
        one = F.array(F.struct(x["text"].alias("text"), x["kind"].alias("kind"), _norm(x["kind"], x["text"]).alias("norm")))
        return F.when(x["kind"] == "name", F.transform(F.split(x["text"], " "), word)).otherwise(one)

    return F.transform(typed, parts)


def entities_of(mentions: Column) -> Column:
    """Array of struct(text, kind, norm) of the entities that the mentions name."""
    return F.filter(F.flatten(parts_of(mentions)), lambda p: p["kind"].isNotNull())


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, mod 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _stream(hexa: Column) -> Column:
    return F.translate(hexa, "abcdef", "012345")


def _checked(norm: Column, drawn: Column) -> Column:
    """``drawn`` with its last digit set so that its Luhn check is valid exactly if that of ``norm`` is."""
    body = F.left(drawn, F.length(drawn) - 1)
    right = (10 - _luhn_sum(F.concat(body, F.lit("0")))) % 10
    last = F.when(_luhn_sum(norm) == 0, right).when(F.right(drawn, F.lit(1)).cast("int") == right, (right + 1) % 10).otherwise(F.right(drawn, F.lit(1)).cast("int"))
    return F.concat(body, last.cast("string"))


def _mod97(code: Column) -> Column:
    """Remainder of an IBAN by 97; 1 if its check digits are right."""
    turned = F.concat(F.substring(code, 5, 64), F.left(code, F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.conv(c, 36, 10).cast("int")) % 97)


def _iban(norm: Column, drawn: Column) -> Column:
    """An IBAN of the same country; its check digits are right exactly if those of ``norm`` are."""
    right = 98 - _mod97(F.concat(F.left(norm, F.lit(2)), F.lit("00"), drawn))
    check = F.when(_mod97(norm) == 1, right).otherwise(right % 97 + 1)
    return F.concat(F.left(norm, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), drawn)


def _spelled(hexa: Column, parts: list[str]) -> Column:
    """A word with one of 16 syllables for each hexadecimal digit."""
    pool = F.array(*(F.lit(x) for x in parts))
    return F.array_join(F.transform(F.split(hexa, ""), lambda h: F.get(pool, F.conv(h, 16, 10).cast("int"))), "")


def surrogate_norm(spec: SurrogateSpec, kind: Column, norm: Column, one: Column, two: Column) -> Column:
    """Normalized surrogate of an entity, drawn from its two digests."""
    digits = F.concat(_stream(one), _stream(two))
    letters = F.translate(two, "0123456789", "ghijklmnop")
    octet = lambda i, low, n: (F.conv(F.substring(one, 1 + 6 * i, 6), 16, 10).cast("long") % n + low).cast("string")

    def shaped(c: Column, i: Column) -> Column:
        letter = F.substring(letters, 1 + i % 64, F.lit(1))
        cyrillic = F.translate(letter, "abcdefghijklmnop", "абвгдежзиклмнопр")
        return F.when(c.rlike(r"\p{IsCyrillic}"), cyrillic).when(c.rlike(r"\p{L}"), letter).when(c.rlike("[0-9]"), F.substring(digits, 1 + i % 64, F.lit(1))).otherwise(c)

    domain = F.substring_index(norm, "@", -1)
    site = F.concat(F.lit("mail"), F.left(_stream(_digest(spec, F.lit("domain"), domain, F.lit(0), "3")), F.lit(6)), F.lit(".example."), F.substring_index(domain, ".", -1))
    email = F.concat(F.array_join(F.transform(F.split(F.substring_index(norm, "@", 1), ""), shaped), ""), F.substring(digits, 70, 6), F.lit("@"), site)
    country, number = F.substring_index(norm, "-", 1), F.substring_index(norm, "-", -1)
    lead = F.translate(F.left(digits, F.lit(1)), "01", "29")  # no number starts with 0 or 1
    lead = F.when(country == "34", F.translate(lead, "2345", "6789")).otherwise(lead)
    fourth = F.when(country == "1", F.translate(F.substring(digits, 4, 1), "01", "29")).otherwise(F.substring(digits, 4, 1))
    phone = F.concat(country, F.lit("-"), F.left(F.concat(lead, F.substring(digits, 2, 2), fourth, F.substring(digits, 5, 60)), F.length(number)))
    code = F.transform(F.split(F.substring(norm, 5, 64), ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, 3 + i, F.lit(1))).otherwise(F.upper(F.substring(letters, 1 + i, F.lit(1)))))
    part = lambda i, n: F.conv(F.substring(one, 1 + 6 * i, 6), 16, 10).cast("long") % n + 1
    area = F.when(part(0, 898) < 666, part(0, 898)).otherwise(part(0, 898) + 1)  # 001 to 899 without 666
    ssn = F.concat(*(F.lpad(x.cast("string"), w, "0") for x, w in ((area, 3), (part(1, 99), 2), (part(2, 9999), 4))))
    ip6 = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(F.translate(F.substring(one, 1 + i, F.lit(1)), "0", "f"))), "")
    found = (
        F.when(kind == "email", email)
        .when(kind == "ip", F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
        .when(kind == "phone", phone)
        .when(kind == "ip6", ip6)
        .when(kind == "iban", _iban(norm, F.array_join(code, "")))
        .when(kind == "ssn", ssn)
        .when(kind == "card", _checked(norm, F.left(digits, F.length(norm))))
    )
    for group in GIVEN:
        table = F.create_map(*(F.lit(x) for pair in given_surrogates(spec, group).items() for x in pair))
        found = found.when(kind == f"name:{group}", F.try_element_at(table, norm))
    for script, parts in _SYLLABLES.items():
        found = found.when(kind == f"name:{script}", _spelled(F.substring(one, 1, 5), parts))
    return found


def _lengthened(spec: SurrogateSpec, kind: Column, two: Column, attempt: Column, s: Column) -> Column:
    """``s`` with one more syllable or digit for every ``patience`` attempts, so that surrogates never run out."""
    n = F.floor(attempt / spec.patience).cast("int")
    more = F.left(_stream(two), n)
    for script, parts in _SYLLABLES.items():
        more = F.when(kind == f"name:{script}", _spelled(F.substring(two, F.lit(1), n), parts)).otherwise(more)
    longer = F.when(kind == "email", F.concat(more, s)).when(kind.isin("ip", "ip6"), F.concat(s, F.lit("/"), more)).otherwise(F.concat(s, more))
    return F.when(attempt < spec.patience, s).otherwise(longer)


def _fill_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order; more digits than it has follow at its end."""
    place = lambda i: F.length(_digits_only(F.substring(shape, F.lit(1), i + 1)))
    filled = F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")
    return F.concat(filled, F.substring(digits, F.length(_digits_only(shape)) + 1, F.length(digits)))


def _fill_alnum(shape: Column, text: Column) -> Column:
    place = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i + 1), " ", ""))
    filled = F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c != " ", F.substring(text, place(i), F.lit(1))).otherwise(c)), "")
    return F.concat(filled, F.substring(text, F.length(F.regexp_replace(shape, " ", "")) + 1, F.length(text)))


def _cased(like: Column, word: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(word)).when(F.lower(like) == like, word).otherwise(F.initcap(word))


def _formatted(text: Column, kind: Column, norm: Column, s: Column) -> Column:
    """A surrogate in the format of a mention's part; parts without a kind stay."""
    lead = F.regexp_extract(text, rf"^\+(?:{_COUNTRY})", 0)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    trunk = F.left(_digits_only(rest), F.length(_digits_only(rest)) - F.length(F.substring_index(norm, "-", -1)))
    return (
        F.when(kind.isNull(), text)
        .when(kind.startswith("name"), _cased(text, s))
        .when(kind == "phone", F.concat(lead, _fill_digits(rest, F.concat(trunk, F.substring_index(s, "-", -1)))))
        .when(kind.isin("card", "ssn"), _fill_digits(text, s))
        .when(kind == "iban", _fill_alnum(text, s))
        .when(kind.isin("email", "ip6") & (F.upper(text) == text), F.upper(s))
        .otherwise(s)
    )


def surrogates_of(spec: SurrogateSpec, mentions: Column, attempt_of) -> Column:
    """Replacements of an array of mentions; ``attempt_of(kind, norm)`` gives the attempt of an entity."""

    def each(f):
        return lambda ps: F.transform(ps, f)

    tried = F.transform(parts_of(mentions), each(lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), p["norm"].alias("norm"), attempt_of(p["kind"], p["norm"]).alias("attempt"))))
    drawn = F.transform(tried, each(lambda p: F.struct(*(p[c].alias(c) for c in ("text", "kind", "norm", "attempt")), *(_digest(spec, p["kind"], p["norm"], p["attempt"], n).alias(c) for n, c in (("1", "one"), ("2", "two"))))))
    found = F.transform(drawn, each(lambda p: F.struct(p["text"].alias("text"), p["kind"].alias("kind"), p["norm"].alias("norm"), _lengthened(spec, p["kind"], p["two"], p["attempt"], surrogate_norm(spec, p["kind"], p["norm"], p["one"], p["two"])).alias("s"))))
    return F.transform(found, lambda ps: F.array_join(F.transform(ps, lambda p: _formatted(p["text"], p["kind"], p["norm"], p["s"])), " "))


def assign_attempts(entities: DataFrame, spec: SurrogateSpec, ws: Workspace) -> DataFrame | None:
    """(kind, norm, attempt) of the entities whose first surrogate collides; None if there are none.

    ``entities``: distinct (kind, norm). A surrogate is taken by the least attempt, then the least norm.
    """
    given = [f"name:{g}" for g in GIVEN]
    open_ = entities.where(~F.col("kind").isin(given))  # exchanges inside a list can't collide
    drawn = open_.withColumn("attempt", F.lit(0))
    moved = None
    for step in itertools.count():
        keys = (F.col("kind"), F.col("norm"), F.col("attempt"))
        all_ = drawn.withColumns({"one": _digest(spec, *keys, "1"), "two": _digest(spec, *keys, "2")})
        all_ = all_.select("kind", "norm", "attempt", _lengthened(spec, F.col("kind"), F.col("two"), F.col("attempt"), surrogate_norm(spec, F.col("kind"), F.col("norm"), F.col("one"), F.col("two"))).alias("s"))
        nth = F.row_number().over(Window.partitionBy("kind", "s").orderBy("attempt", "norm"))
        original = entities.select("kind", F.col("norm").alias("s"), F.lit(True).alias("taken"))
        ranked = all_.withColumn("nth", nth).join(original, ["kind", "s"], "left")
        bad = ws.save(ranked.where("nth > 1 or taken").select("kind", "norm"), f"bad{step}")
        if bad.isEmpty():
            break
        again = bad.withColumn("again", F.lit(1))
        drawn = ws.save(drawn.join(again, ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), f"drawn{step}")
        moved = drawn.where("attempt > 0")
    return moved


def _pieces(text: Column) -> Column:
    """What lies before, in and after mentions, in turn: an odd number of pieces, of which every other is a mention."""
    marked = F.split(F.regexp_replace(text, MENTION, f"{_MARK}$0{_MARK}"), _MARK, -1)
    gaps, mentions = F.split(text, MENTION, -1), F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    apart = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(mentions), F.array(g, F.get(mentions, i))).otherwise(F.array(g))))
    return F.when(text.contains(_MARK), apart).otherwise(marked)


def replace_entities(docs: DataFrame, spec: SurrogateSpec | None = None, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``count`` names a column for the number of mentions replaced, new or not."""
    spec = spec or SurrogateSpec()
    ws = Workspace(docs.sparkSession, "surrogates")
    mentions = F.filter("pieces", lambda _, i: i % 2 == 1)
    split = docs.select(F.col(key).alias("id"), _pieces(F.col(text)).alias("pieces")).where(F.size("pieces") > 1)
    found = ws.save(split.select("id", F.explode(entities_of(mentions)).alias("e")).select("id", "e.kind", "e.norm"), "found")
    moved = assign_attempts(ws.save(found.select("kind", "norm").distinct(), "entities"), spec, ws)
    ws.release()
    row, pieces, tries, of = (_unused(n, [*docs.columns, count]) for n in ("row", "pieces", "tries", "of"))
    rows = docs.select(F.struct(*docs.columns).alias(row), _pieces(F.col(text)).alias(pieces))
    attempt_of = lambda kind, norm: F.lit(0)
    if moved is not None:
        pairs = found.distinct().join(moved, ["kind", "norm"])
        maps = pairs.groupBy(F.col("id").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias(tries))
        rows = rows.join(maps, F.col(row)[key].eqNullSafe(F.col(of)), "left")
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(tries, F.concat_ws("|", kind, norm)), F.lit(0))
    new = surrogates_of(spec, F.filter(pieces, lambda _, i: i % 2 == 1), attempt_of)
    gaps = F.filter(pieces, lambda _, i: i % 2 == 0)
    hit = F.size(pieces) > 1
    rewritten = F.when(hit, F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")).otherwise(F.col(row)[text])
    new_columns = {text: rewritten} | ({count: F.when(hit, F.floor(F.size(pieces) / 2)).otherwise(0).cast("long")} if count else {})
    return rows.select(*(new_columns.pop(c, F.col(row)[c]).alias(c) for c in docs.columns), *(v.alias(c) for c, v in new_columns.items()))


def _unused(name: str, taken: list[str | None]) -> str:
    while name in taken:
        name = f"_{name}"
    return name
