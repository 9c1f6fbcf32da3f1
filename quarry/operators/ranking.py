"""Ranks, fusion, first-wins, budgets and orders. Every order has an explicit last tie-break."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.lexicon import RRF_K


def top_k(df: DataFrame, score: str, key: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows by score, ties to the smaller key, with their rank.

    Spark takes them with a bounded heap per task; only k rows are numbered in one place.
    """
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)))


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def top_per_group(df: DataFrame, group: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops the others before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf) from tables of (key, rank): the sum of 1 / (k + rank)."""
    rows = reduce(DataFrame.unionByName, (r.select(key, "rank") for r in rankings))
    return rows.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf"))


def fuse(rankings: list[DataFrame], key: str, keep: int, k: int = RRF_K, scores: list[str] | None = None, group: list[str] | None = None) -> DataFrame:
    """Fused ranking, cut to ``keep``; ties go to the earlier list, then to its rank.

    ``scores`` are columns of any of the lists that stay, so that no list is asked for again; with ``group`` there is one ranking of each.
    """
    scores, group = scores or [], group or []
    kept = lambda r: [F.col(c) if c in r.columns else F.lit(None).alias(c) for c in scores]
    tagged = [r.select(*group, key, "rank", F.lit(i).alias("_list"), *kept(r)) for i, r in enumerate(rankings)]
    rows = reduce(DataFrame.unionByName, tagged)
    total = F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf")
    fused = rows.groupBy(*group, key).agg(total, F.min(F.struct("_list", "rank")).alias("_first"), *(F.max(c).alias(c) for c in scores))
    order = [F.desc(F.round("rrf", 12)), "_first", key]
    if group:
        return top_per_group(fused, group, order, keep).drop("_first")
    best = fused.orderBy(*order).limit(keep)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_first")


def merge_rankings(first: DataFrame, second: DataFrame, key: str, keep: int) -> DataFrame:
    """Two result lists fused; a row that both have is taken from the first one."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    rows = first_wins(both, [key], ["_from", "rank"]).drop("_from", "rank")
    return fuse([first, second], key, keep).join(rows, key)


def make_unique(df: DataFrame, name: str, pos: str, group: list[str] | None = None) -> DataFrame:
    """x, x-1, x-2 ... in order of position; a name that is taken already is skipped, as often as needed."""
    group = group or []
    nth = F.row_number().over(Window.partitionBy(*group, name).orderBy(pos)) - 1
    tried = df.withColumn("_nth", nth)
    plain = F.concat(F.col(name), F.when(F.col("_nth") > 0, F.concat(F.lit("-"), F.col("_nth").cast("string"))).otherwise(""))
    tried = tried.withColumn("unique_name", plain)
    taken = df.select(*group, F.col(name).alias("unique_name")).distinct().withColumn("_taken", F.lit(True))
    clash = tried.join(taken, [*group, "unique_name"], "left").withColumn("_clash", F.col("_taken").isNotNull() & (F.col("_nth") > 0))
    # a clashing suffix moves behind the highest suffix in use for that name
    high = F.regexp_extract("unique_name", r"-(\d+)$", 1).try_cast("long")
    base = F.regexp_replace("unique_name", r"-\d+$", "")
    used = taken.select(*group, base.alias(name), high.alias("_high")).where("_high is not null").groupBy(*group, name).agg(F.max("_high").alias("_high"))
    count = df.groupBy(*group, name).count().withColumnRenamed("count", "_count")
    again = clash.join(used, [*group, name], "left").join(count, [*group, name], "left")
    moved = F.row_number().over(Window.partitionBy(*group, name, "_clash").orderBy(pos))
    late = F.concat(F.col(name), F.lit("-"), (F.greatest(F.coalesce("_high", F.lit(0)), F.col("_count") - 1) + moved).cast("string"))
    return again.withColumn("unique_name", F.when(F.col("_clash"), late).otherwise(F.col("unique_name"))).drop("_nth", "_taken", "_clash", "_high", "_count")


def budget_prefix(df: DataFrame, size: Column, order: list[Column | str], budget: int, group: list[str] | None = None) -> DataFrame:
    """The longest prefix whose sizes fit the budget; the first row always stays. Sizes are 0 at least.

    Without a group, sizes of 1 and more fill the budget after as many rows at most, so that many rows are taken in order
    first and no task orders the whole table; rows of size 0 make the prefix longer, and then all rows are ordered.
    """
    sized = df.withColumn("_size", size)
    if group is None and not (sized.where("_size < 1").limit(1).count()):
        sized = sized.orderBy(*order).limit(budget + 1)
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    run = F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = sized.withColumn("_run", run).withColumn("_nth", F.row_number().over(w))
    return out.where((F.col("_run") <= budget) | (F.col("_nth") == 1)).drop("_size", "_run", "_nth")


def running_number(is_start: Column, order: str, group: list[str]) -> Column:
    """Number of the section a row belongs to: how many starts came so far."""
    return F.sum(F.when(is_start, 1).otherwise(0)).over(Window.partitionBy(*group).orderBy(order))


def by_recency(df: DataFrame, date: str, pos: str) -> DataFrame:
    """Newest text date first, missing last, then the former order."""
    return df.orderBy(F.coalesce(date, F.lit("")).desc(), pos)


def max_marginal_relevance(df: DataFrame, group: str, key: str, vector: str, relevance: str, trade: float = 0.5) -> DataFrame:
    """Greedy re-order of each group's few rows: relevance against similarity to what was chosen before.

    The rows of a group are one result list (tens of rows), so they fit a task.
    """
    schema = f"{group} {df.schema[group].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, mmr_rank int"

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values(key, ignore_index=True)
        v = np.stack(rows[vector]).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
        rel, same = rows[relevance].to_numpy(float), v @ v.T
        chosen, left, worst = [], list(range(len(rows))), np.full(len(rows), -np.inf)
        while left:
            score = rel[left] if not chosen else trade * rel[left] - (1 - trade) * worst[left]
            at = left.pop(int(np.argmax(score)))
            chosen.append(at)
            worst = np.maximum(worst, same[at])
        return pd.DataFrame({group: rows[group].iloc[0], key: rows[key].iloc[chosen].to_numpy(), "mmr_rank": range(1, len(rows) + 1)})

    return df.select(group, key, vector, relevance).groupBy(group).applyInPandas(order, schema)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A fixed sample of at most n rows: the smallest hashes of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
