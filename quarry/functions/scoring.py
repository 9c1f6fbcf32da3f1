"""Readers and scorers of model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.functions.text import extract, nullif_empty, strip, tokens


def mcq_letter(x: Column) -> Column:
    """Leading letter, else 'answer is X', else a letter at the end, else ''."""
    t = strip(F.coalesce(x, F.lit("")))
    leading, stated, ending = (extract(t, p) for p in lexicon.ANSWER_LETTERS)
    return F.coalesce(leading, F.upper(stated), ending, F.lit(""))


def number(x: Column) -> Column:
    """The number after ####, else the last number, without commas; else ''."""
    x = F.coalesce(x, F.lit(""))
    marked_number, any_number = lexicon.ANSWER_NUMBERS
    marked = extract(x, marked_number)
    last = nullif_empty(F.try_element_at(F.regexp_extract_all(x, F.lit(any_number), F.lit(1)), F.lit(-1)))
    return F.replace(F.coalesce(marked, last, F.lit("")), F.lit(","), F.lit(""))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of distinct lower-case tokens; two empty texts agree."""
    p, g = F.array_distinct(tokens(pred)), F.array_distinct(tokens(gold))
    both = F.size(F.array_intersect(p, g)).cast("double")
    precision, recall = F.try_divide(both, F.size(p)), F.try_divide(both, F.size(g))
    f1 = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(f1)


def says_yes(x: Column) -> Column:
    """'yes' is one of the first three tokens."""
    return F.array_contains(F.slice(tokens(x), 1, 3), "yes")


def decision(x: Column) -> Column:
    """yes, no or maybe by the first 20 characters."""
    head = F.substring(F.lower(F.coalesce(x, F.lit(""))), 1, 20)
    return F.when(head.contains("yes"), "yes").when(head.contains("no"), "no").otherwise("maybe")


def has_call(x: Column) -> Column:
    """Something that looks like a function call."""
    return F.coalesce(x, F.lit("")).rlike(lexicon.FUNCTION_CALL)
