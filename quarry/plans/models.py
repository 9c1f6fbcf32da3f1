"""Model plans: what is missing, totals by wave and family, memory fit, routing by task and tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import format_gb

# Models of each task, and settings of each tier; both are data and may be replaced.
TASKS = {"query_parsing": "llama3.1-8b", "metadata_extraction": "qwen2.5-7b", "ontology_normalization": "qwen3.5-9b", "answer_generation": "qwen3.5-9b", "relevance_judgment": "qwen3.5-9b", "fast_utility": "qwen2.5-0.5b"}
TIERS = {
    "quality": {"parse_model": "llama3.1-8b", "answer_model": "qwen3.5-9b", "strategy": "hybrid+filter", "context_format": "structured", "context_k": 3},
    "fast": {"parse_model": "qwen2.5-1.5b", "answer_model": "qwen2.5-1.5b", "strategy": "dense", "context_format": "structured", "context_k": 3},
    "balanced": {"parse_model": "llama3.1-8b", "answer_model": "qwen3.5-9b", "strategy": "hybrid+filter", "context_format": "structured", "context_k": 3},
}


class Router:
    """Model of a task among registered ones, with a default; tiers fall back to 'balanced'."""

    def __init__(self, registered: set[str], default: str, tasks: dict[str, str] | None = None):
        self.registered, self.default, self.tasks = set(registered), default, dict(tasks or TASKS)

    def model(self, task: str, fallback: str | None = None) -> str:
        wanted = self.tasks.get(task, fallback or self.default)
        return wanted if wanted in self.registered else self.default

    def tier(self, name: str) -> dict:
        return dict(TIERS.get(name, TIERS["balanced"]))

    def update(self, task: str, model: str) -> None:
        if model in self.registered:
            self.tasks[task] = model


def resolve_names(wanted: DataFrame, registry: DataFrame, families: DataFrame) -> DataFrame:
    """Model keys of full names (first registered wins, ':latest' ignored) with their family's settings or defaults.

    ``wanted``: name; ``registry``: key, full_name, family, pos; ``families``: family, json_hint.
    """
    plain = lambda c: F.regexp_replace(c, ":latest$", "")
    by_name = registry.groupBy(plain(F.col("full_name")).alias("n")).agg(F.min_by(F.struct("key", "family"), "pos").alias("r"))
    by_key = registry.select(F.col("key").alias("n"), F.struct("key", "family").alias("k"))
    x = wanted.withColumn("n", plain(F.col("name"))).join(by_key, "n", "left").join(by_name, "n", "left")
    x = x.select("name", F.coalesce(F.col("k.key"), F.col("r.key")).alias("key"), F.coalesce(F.col("k.family"), F.col("r.family"), F.lit("unknown")).alias("family"))
    return x.join(families, "family", "left").withColumn("json_hint", F.coalesce("json_hint", F.lit("")))


def build_plan(models: DataFrame, pulled: DataFrame) -> DataFrame:
    """Registered models with pulled flag and download size, in order of wave, family and size.

    ``models``: key, full_name, family, wave, size_b, vram_gb, enabled, cpu_spill.
    """
    names = pulled.select(F.regexp_replace("name", ":latest$", "").alias("full_name")).distinct().withColumn("pulled", F.lit(True))
    out = models.join(names, "full_name", "left").withColumn("pulled", F.coalesce("pulled", F.lit(False)))
    return out.withColumn("download_gb", F.coalesce("vram_gb", F.lit(5.0))).orderBy("wave", "family", F.desc("size_b"), "key")


def filter_plan(plan: DataFrame, missing_only: bool = False, wave: int | None = None, family: str | None = None) -> DataFrame:
    out = plan.where("not pulled") if missing_only else plan
    out = out.where(F.col("wave") == wave) if wave is not None else out
    return out.where(F.col("family") == family) if family else out


def plan_totals(plan: DataFrame) -> DataFrame:
    """Totals by wave and family, by wave, and of all."""
    gb = F.sum(F.when(~F.col("pulled"), F.col("download_gb")).otherwise(0.0))
    out = plan.rollup("wave", "family").agg(F.grouping_id().alias("level"), F.count("*").alias("models"), F.count_if("pulled").alias("have"), F.count_if(F.col("enabled") & ~F.col("cpu_spill")).alias("configs"), gb.alias("missing_gb"))
    return out.withColumn("missing_text", format_gb(F.col("missing_gb")))


def memory_fit(plan: DataFrame, budget_gb: float = 24.5) -> DataFrame:
    """Enabled models by need of memory, with the share of the budget."""
    share = F.col("vram_gb") / budget_gb * 100
    rows = plan.where("enabled and not cpu_spill").select("key", "vram_gb", F.round(share, 1).alias("percent"), F.when(share <= 100, "OK").otherwise("OVER").alias("fit"))
    return rows.orderBy(F.desc("vram_gb"), "key")


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``rows`` with every setting of ``defaults``: a row's own value where it has one, else the default; lists and texts alike."""
    held = set(rows.columns)
    value = lambda v: F.array(*(F.lit(x) for x in v)) if isinstance(v, (list, tuple, set)) else F.lit(v)
    return rows.withColumns({k: F.coalesce(F.col(k), value(v)) if k in held else value(v) for k, v in defaults.items()})
