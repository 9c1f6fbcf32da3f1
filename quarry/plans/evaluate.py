"""Scores of model answers by task, and composites over datasets and categories."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scoring import decision, has_call, mcq_letter, number, says_yes, token_f1
from quarry.functions.text import json_text
from quarry.operators.ranking import top_per_group
from quarry.runtime import Workspace
from quarry.versions import VersionedTable

_LETTERS = "ABCD"


def _field(name: str) -> Column:
    return F.get_json_object("item", f"$.{name}")


def _letter_at(index: Column) -> Column:
    return F.when(index.between(0, 3), F.substring(F.lit(_LETTERS), index + 1, F.lit(1)))


def shuffled_choices(item_id: Column, choices: Column) -> Column:
    """Choices in a fixed pseudo-random order of the item."""
    return F.transform(F.array_sort(F.transform(choices, lambda c: F.struct(F.md5(F.concat(c, F.lit("|"), item_id)).alias("h"), c.alias("c")))), lambda x: x["c"])


def mcq_prompt(question: Column, choices: Column, context: Column | None = None) -> Column:
    """Question with at most four lettered choices."""
    lines = F.transform(F.slice(choices, 1, 4), lambda c, i: F.concat(F.substring(F.lit(_LETTERS), i + 1, F.lit(1)), F.lit(". "), c))
    lead = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context)) if context is not None else F.lit(None).cast("string")
    return F.concat_ws("\n", lead, F.concat(F.lit("Question: "), question), F.array_join(lines, "\n"), F.lit("\nAnswer with ONLY the letter (A, B, C, or D)."))


def score_items(items: DataFrame) -> DataFrame:
    """``items`` (evaluator, answer_field, shift, item_id, item as JSON, response) with counted, correct and score.

    counted is false for items that don't enter the totals; score is null where a task has none.
    """
    raw = F.coalesce("response", F.lit(""))
    gold = F.coalesce(F.expr("get_json_object(item, '$.' || answer_field)"), F.lit(""))
    letter = mcq_letter(raw)
    shift = F.coalesce("shift", F.lit(0))
    index = gold.try_cast("int")
    truth = F.from_json(_field("mc1_targets"), "struct<choices: array<string>, labels: array<int>>")
    at = F.when(letter == "", 0).otherwise(F.instr(F.lit(_LETTERS), letter) - 1)
    choices = F.array(*(F.coalesce(_field(f"distractor{i}"), F.lit("")) for i in (1, 2, 3)), F.coalesce(_field("correct_answer"), F.lit("")))
    place = F.array_position(shuffled_choices(F.col("item_id"), choices), F.coalesce(_field("correct_answer"), F.lit(""))) - 1
    rules = F.coalesce(F.from_json(_field("instruction_id_list"), "array<string>"), F.array().cast("array<string>"))
    broken = F.size(F.filter(rules, lambda r: r.contains("no_comma") & ~r.contains("number_words") & raw.contains(",")))
    share = F.try_divide(F.size(rules) - broken, F.size(rules))
    first = F.coalesce(F.get(F.from_json(F.get_json_object(gold, "$.text"), "array<string>"), F.lit(0)), F.get(F.from_json(F.when(gold.startswith("["), gold), "array<string>"), F.lit(0)))
    text = F.when(gold.startswith("{") | gold.startswith("["), F.coalesce(first, F.lit(""))).otherwise(gold)
    want = F.coalesce(_field("python_function_name"), F.lit(""))
    named = (want != "") & F.lower(raw).contains(F.lower(want))
    e = F.col("evaluator")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    correct = (
        F.when(e == "mcq_letter", one(letter == F.upper(gold)))
        .when(e == "mcq_index_str", one(letter == _letter_at(index + shift)))
        .when(e == "mcq_index", one(letter == _letter_at(index)))
        .when(e == "binary_choice", one(F.regexp_extract(raw, "([12])", 1) == gold))
        .when(e == "boolean", one(says_yes(raw) == (F.lower(gold) == "true")))
        .when(e == "gsm8k", one((number(raw) != "") & (number(raw) == number(gold))))
        .when(e == "truthfulqa", one(F.get(truth["labels"], at) == 1))
        .when(e == "pubmedqa", one(decision(raw) == gold))
        .when(e == "sciq", one((letter != "") & (F.instr(F.lit(_LETTERS), letter) - 1 == place)))
        .when(e == "token_f1", F.lit(0))
        .when(e == "ifeval", one(broken == 0))
        .when(e == "json_schema", one(json_text(raw).isNotNull()))
        .when(e.isin("nexus_fc", "glaive_fc", "toolace"), one(has_call(raw)))
    )
    score = (
        F.when(e == "token_f1", token_f1(raw, text))
        .when(e == "ifeval", share)
        .when(e == "nexus_fc", F.when(named, 1.0).when(want != "", 0.0).otherwise(has_call(raw).cast("double")))
        .when(e.isin("glaive_fc", "toolace"), has_call(raw).cast("double"))
    )
    counted = F.when((e == "mcq_index") & gold.rlike(r"^\d+$"), index < 4).when(e == "truthfulqa", F.size(F.coalesce(truth["choices"], F.array().cast("array<string>"))) > 0).otherwise(correct.isNotNull())
    return items.withColumns({"counted": counted, "correct": correct, "score": score})


def dataset_results(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Number of items, accuracy and mean score, rounded to four digits."""
    rows = scored.where("counted")
    return rows.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.round(F.avg("correct"), 4).alias("accuracy"), F.round(F.avg("score"), 4).alias("avg_score"))


def category_composites(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the datasets' accuracies."""
    return results.groupBy(*keys).agg(F.round(F.avg("accuracy"), 4).alias("composite"), F.count("*").alias("datasets"))


def run_records(composites: DataFrame, model: str = "model", category: str = "category") -> DataFrame:
    """One row per model with a map of its composites."""
    return composites.groupBy(model).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "composite")))).alias("composites"))


def open_runs(panel: DataFrame, done: DataFrame, key: str = "model") -> DataFrame:
    """Members of the panel without a finished run."""
    return panel.join(done.select(key), key, "left_anti")


def prompts(items: DataFrame, choices_field: str = "choices", context_field: str = "context") -> DataFrame:
    """``items`` with the prompt of each task; passages and contexts are cut to 500 characters."""
    e, q = F.col("evaluator"), F.coalesce(_field("question"), F.lit(""))
    listed = F.from_json(F.coalesce(_field(f"{choices_field}.text"), _field(choices_field)), "array<string>")
    named = F.array(*(F.coalesce(_field(f"op{x}"), F.lit("")) for x in "abcd"))
    truth = F.from_json(_field("mc1_targets.choices"), "array<string>")
    science = shuffled_choices(F.col("item_id"), F.array(*(F.coalesce(_field(f"distractor{i}"), F.lit("")) for i in (1, 2, 3)), F.coalesce(_field("correct_answer"), F.lit(""))))
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 500)
    parts = F.array_join(F.from_json(_field("context.contexts"), "array<string>"), " ")
    ask = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in xs))
    user = F.regexp_extract(F.coalesce(_field("chat"), F.lit("")), r"(?s)USER:\s*(.*?)\s*(?:ASSISTANT:|$)", 1)
    messages = F.from_json(_field("prompt"), "array<struct<content: string>>")
    talk = F.from_json(_field("conversations"), "array<struct<value: string>>")
    prompt = (
        F.when(e.startswith("mcq"), mcq_prompt(q, F.coalesce(listed, named), _field(context_field)))
        .when(e == "binary_choice", ask(_field("sentence"), "\n\n1. ", _field("option1"), "\n2. ", _field("option2"), "\n\nReply with 1 or 2 only."))
        .when(e == "boolean", ask("Passage: ", cut(_field("passage")), "\n\nQuestion: ", q, "\n\nReply with yes or no only."))
        .when(e == "gsm8k", ask("Reason step by step and put the final number after ####.\n\n", q))
        .when(e == "truthfulqa", mcq_prompt(q, truth))
        .when(e == "pubmedqa", ask("Context: ", cut(parts), "\n\nQuestion: ", q, "\n\nReply with yes, no or maybe only."))
        .when(e == "sciq", mcq_prompt(q, science))
        .when(e == "token_f1", ask("Context: ", cut(_field("context")), "\n\nQuestion: ", q, "\n\nReply briefly."))
        .when(e == "json_schema", F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], _field("prompt")))
        .when(e == "glaive_fc", F.when(user != "", user).otherwise(cut(_field("chat"))))
        .when(e == "toolace", F.get(talk, F.lit(0))["value"])
        .otherwise(_field("prompt"))
    )
    return items.withColumn("prompt", F.coalesce(prompt, F.lit("")))


def answer_items(items: DataFrame, generate, batch: int = 16) -> DataFrame:
    """``items`` with the generator's response to each prompt; a call that fails leaves a null, which isn't counted.

    A generator with ``many`` gets up to ``batch`` prompts at once, others one by one; if many fail together, each is asked alone.
    """
    many = getattr(generate, "many", None)

    def one(p: str) -> str | None:
        try:
            return many([p])[0] if many else generate(p)
        except Exception:  # any failure of the provider
            return None

    def some(prompts: list[str]) -> list[str | None]:
        if many:
            try:
                return list(many(prompts))
            except Exception:
                pass
        return [one(p) for p in prompts]

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = b.tolist()
            yield pd.Series([r for i in range(0, len(texts), batch) for r in some(texts[i : i + batch])], index=b.index, dtype=object)

    return items.withColumn("response", ask("prompt"))


def first_items(items: DataFrame, most: int, dataset: str = "dataset", key: str = "item_id") -> DataFrame:
    """At most so many items of each dataset, by the hash of their ids: the sample of an evaluation."""
    return top_per_group(items, [dataset], [F.xxhash64(key), key], most, "_nth").drop("_nth")


class PanelIncomplete(ValueError):
    """Members of a frozen panel that aren't there."""


#: The models of the public panel, in order.
PUBLIC_PANEL = ("qwen2.5-0.5b", "qwen3-8b", "qwen3.5-9b-q8", "llama3.1-8b", "llama3.2-3b", "gemma3-12b-q8", "mistral-7b", "phi4-14b-q8", "falcon3-7b", "aya-expanse-8b", "granite3.3-8b")

CLOSED = "closed"


def run_panel(spark: SparkSession, root: str, items: DataFrame, generator_of: Callable[[str], Callable[[str], str]], panel: list[str] | None = None, available: set[str] | None = None, most: int = 200) -> DataFrame:
    """Results (label, model, dataset, category, n_samples, accuracy, avg_score, seconds) of a panel of models.

    ``items``: dataset, category, evaluator, answer_field, shift, item_id, item. Without ``panel`` it is the public one, which is frozen: all of its members
    have to be available, and once they are done the results are closed. A given panel runs those of its members that are available.
    Each model's results are a version of their own, so a run that was stopped goes on with the models it hasn't committed.
    """
    frozen = panel is None
    wanted = list(PUBLIC_PANEL if frozen else panel)
    lost = [m for m in wanted if available is not None and m not in available]
    if frozen and lost:
        raise PanelIncomplete(f"the panel lacks {', '.join(lost)}")
    store = VersionedTable(spark, root)
    ws = Workspace(spark, "panel")
    asked = None
    for model in wanted:
        at = store.current()
        if at and at.note == CLOSED:
            break
        old = store.read() if at else None
        if model in lost or (old is not None and not old.where(F.col("label") == model).isEmpty()):
            continue
        if asked is None:
            asked = ws.save(prompts(first_items(items, most)), "prompts")
        began = time.time()
        scored = ws.save(score_items(answer_items(asked, generator_of(model))), "scored")
        took = F.lit(round(time.time() - began, 1)).alias("seconds")
        new = dataset_results(scored, ["dataset", "category"]).select(F.lit(model).alias("label"), F.lit(model).alias("model"), "*", took)
        both = new if old is None else old.unionByName(new)
        store.write(lambda path, rows=both: rows.coalesce(1).write.parquet(path), model)  # a row for each model and dataset
    at = store.current()
    if frozen and at and at.note != CLOSED:
        done = store.read()
        store.write(lambda path: done.coalesce(1).write.parquet(path), CLOSED)
    if store.current() is None:
        raise PanelIncomplete("none of the models is available")
    return store.read()


def read_items(spark: SparkSession, registry: DataFrame, folder: str) -> DataFrame:
    """Items of the registered datasets (dataset, evaluator, answer_field, shift) that lie in ``folder`` as JSON lines.

    A dataset lies in DATASET.json or in files of a folder of that name; registered ones without files are skipped.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(?:\.json)?(?:/part-[^/]*)?$", 1)
    rows = spark.read.option("recursiveFileLookup", True).text(folder).select(name.alias("dataset"), F.col("value").alias("item")).where("item != ''")
    return rows.join(registry, "dataset").withColumn("item_id", F.md5("item"))
