"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (by default domain, language, source). Children share what their parent got by
weight, but none takes more than its capacity: the tokens of all leaves below it times the number of epochs allowed.
What a child can't take goes to its siblings; only when all of them are full does the shortage show at the parent,
whose own siblings take it. Since each node's capacity is known from below before budgets come from above, one
top-down pass of water filling per level does this exactly, in integers; what rounding down leaves over goes to the
children with the largest fractions, one token each, ties to the smaller name.

A leaf's budget is filled from seeded epochs: whole passes over the leaf as often as they fit, then the prefix of one
more pass in the order of ``md5(seed:epoch:doc_id)``. The prefix is the longest whose tokens fit. It is found from
sums over hash buckets, then inside one bucket, so that no task orders a whole leaf; the result is a cut key per leaf,
and documents are selected by comparing their key with it, without moving texts.

Main path: DataFrame functions only. A token is a word here. Defined cases: null levels count as ''; null or blank
texts have no tokens and cost nothing; rows with one doc_id share a key and are selected together; levels without a
given weight get ``default_weight``; a weight of 0 gives no budget while siblings with weight have room; a text of any
length counts whole; an empty table gives an empty result; all columns of the input, whatever their names, stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.text import word_count
from quarry.runtime import Workspace

#: Domain of each source of the test corpus; other sources are 'other'.
DOMAINS = {f"src{i}": ("web", "books", "code", "reference")[i // 5] for i in range(20)}


@dataclass(frozen=True)
class MixSpec:
    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: dict[str, dict[str, int]] = field(
        default_factory=lambda: {
            "domain": {"web": 40, "books": 25, "code": 15, "reference": 20},
            "lang": {"en": 60, "fr": 15, "de": 15, "es": 10},
        }
    )
    default_weight: int = 5
    budget_percent: int = 60
    max_epochs: int = 4
    seed: int = 17
    bucket_docs: int = 256


def with_domain(docs: DataFrame, domains: dict[str, str] | None = None) -> DataFrame:
    """Adds ``domain`` by source; a domain column of the input's own stays as it is."""
    if "domain" in docs.columns:
        return docs
    pairs = [F.lit(x) for kv in sorted((domains or DOMAINS).items()) for x in kv]
    return docs.withColumn("domain", F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(F.col("source"), F.lit(""))), F.lit("other")))


def _weight(level: str, spec: MixSpec) -> Column:
    known = spec.weights.get(level)
    if not known:
        return F.lit(1).cast("long")
    pairs = F.create_map(*(F.lit(x) for kv in sorted(known.items()) for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(spec.default_weight)).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water filling: ``nodes`` (parent..., name, cap, w, b = the parent's budget) get ``budget``."""
    ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("ratio", name) if parent else Window.partitionBy(F.lit(0)).orderBy("ratio", name)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    x = nodes.withColumn("ratio", ratio)
    x = x.withColumn("prev", F.coalesce(F.sum("cap").over(order.rowsBetween(first, -1)), F.lit(0)))
    x = x.withColumn("wrem", F.sum("w").over(order.rowsBetween(0, last)))
    full = F.when(F.col("w") > 0, (F.col("b") - F.col("prev")) * F.col("w") >= F.col("cap") * F.col("wrem")).otherwise(F.lit(False))
    x = x.withColumn("full", full)
    x = x.withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole))
    x = x.withColumn("wopen", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole))
    x = x.withColumn("left", F.col("b") - F.col("taken"))
    # children without weight take what all others leave, in order of name
    idle = Window.partitionBy(*parent, "wopen").orderBy(name).rowsBetween(first, -1) if parent else Window.partitionBy("wopen").orderBy(name).rowsBetween(first, -1)
    x = x.withColumn("idle", F.coalesce(F.sum(F.when(F.col("full"), 0).otherwise(F.col("cap"))).over(idle), F.lit(0)))
    rest = F.greatest(F.lit(0), F.least(F.col("cap"), F.col("left") - F.col("idle")))
    # what rounding down leaves over goes to the largest fractions, one token each
    shared = ~F.col("full") & (F.col("wopen") > 0)
    x = x.withColumns({"base": F.when(shared, F.expr("left * w div wopen")).otherwise(0), "fraction": F.when(shared, F.expr("left * w % wopen")).otherwise(-1)})
    largest = (Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))).orderBy(F.desc("fraction"), name)
    x = x.withColumn("more", (F.row_number().over(largest) <= F.col("left") - F.sum("base").over(whole)).cast("int"))
    budget = F.when(F.col("full"), F.col("cap")).when(F.col("wopen") > 0, F.col("base") + F.col("more")).otherwise(rest)
    return x.withColumn("budget", budget.cast("long")).select(*parent, name, "budget")


def leaf_budgets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """Budget of each leaf. ``sizes``: levels..., tokens, docs."""
    levels = list(spec.levels)
    leaves = sizes.withColumn("cap", F.col("tokens") * spec.max_epochs)
    budgets = None
    for i, name in enumerate(levels):
        parent = levels[:i]
        nodes = leaves.groupBy(*levels[: i + 1]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("t")).withColumn("w", _weight(name, spec))
        if budgets is None:  # the root's budget, from the sums over all of its children
            root = Window.partitionBy(F.lit(0))
            nodes = nodes.withColumns({"t": F.sum("t").over(root), "c": F.sum("cap").over(root)})
            nodes = nodes.withColumn("b", F.least(F.col("c"), F.expr(f"t * {spec.budget_percent} div 100"))).drop("c")
        else:
            nodes = nodes.join(budgets, parent)
        budgets = _share(nodes.drop("t"), parent, name).withColumnRenamed("budget", "b")
    return leaves.join(budgets.withColumnRenamed("b", "budget"), levels)


def _key(spec: MixSpec, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(spec.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix_plan(docs: DataFrame, spec: MixSpec, ws: Workspace, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with levels, doc_id and tokens; leaves with budget, whole epochs and the cut key of the next one)."""
    levels = list(spec.levels)
    rows = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in levels), "doc_id", word_count(F.col(text)).alias("tokens"))
    rows = ws.save(rows, "rows")
    sizes = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = leaf_budgets(sizes, spec)
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1))
    rest = F.when(F.col("tokens") > 0, F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0))
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / spec.bucket_docs))).cast("int")
    leaves = ws.save(leaves.withColumn("epochs", epochs.cast("int")).withColumn("rest", rest).withColumn("digits", digits), "leaves")
    open_ = leaves.where("rest > 0 and tokens > 0").select(*levels, "epochs", "rest", "digits")
    keyed = rows.join(open_, levels).withColumn("key", _key(spec, F.col("epochs")))
    keyed = keyed.withColumn("fine", F.expr("substring(key, 1, digits)")).withColumn("coarse", F.expr("substring(key, 1, (digits + 1) div 2)"))
    sums = keyed.groupBy(*levels, "coarse", "fine").agg(F.sum("tokens").alias("tokens"))
    before = (Window.unboundedPreceding, -1)
    tops = sums.groupBy(*levels, "coarse").agg(F.sum("tokens").alias("tokens"))
    tops = tops.select(*levels, "coarse", F.coalesce(F.sum("tokens").over(Window.partitionBy(*levels).orderBy("coarse").rowsBetween(*before)), F.lit(0)).alias("base"))
    steps = sums.select(*levels, "coarse", "fine", F.coalesce(F.sum("tokens").over(Window.partitionBy(*levels, "coarse").orderBy("fine").rowsBetween(*before)), F.lit(0)).alias("step"), F.col("tokens").alias("size"))
    starts = steps.join(tops, [*levels, "coarse"]).select(*levels, "fine", (F.col("base") + F.col("step")).alias("start"), "size")
    inside = Window.partitionBy(*levels, "fine").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = keyed.select(*levels, "fine", "key", "rest", "tokens").withColumn("run", F.sum("tokens").over(inside))
    fits = run.join(starts, [*levels, "fine"]).where(F.col("start") + F.col("run") <= F.col("rest"))
    cuts = fits.groupBy(*levels).agg(F.max("key").alias("cut"))
    cuts = ws.save(leaves.join(cuts, levels, "left").select(*levels, "budget", "epochs", "cut"), "cuts")
    ws.release()
    return rows, cuts


def _selected(rows: DataFrame, cuts: DataFrame, spec: MixSpec) -> DataFrame:
    """Rows once per epoch that takes them, with ``epoch`` from 0."""
    found = rows.join(cuts, list(spec.levels))
    more = F.coalesce((_key(spec, F.col("epochs")) <= F.col("cut")).cast("int"), F.lit(0))
    copies = F.col("epochs") + more
    return found.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


def mix_sources(docs: DataFrame, spec: MixSpec | None = None, text: str = "text") -> DataFrame:
    """doc_id, levels, tokens and epoch of each selected row."""
    spec = spec or MixSpec()
    ws = Workspace(docs.sparkSession, "mixing")
    rows, cuts = mix_plan(docs, spec, ws, text)
    return _selected(rows, cuts, spec).select("doc_id", *spec.levels, "tokens", "epoch")


def mixed_documents(docs: DataFrame, spec: MixSpec | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, once per epoch, with all columns of ``docs``."""
    spec = spec or MixSpec()
    ws = Workspace(docs.sparkSession, "mixing")
    _, cuts = mix_plan(docs, spec, ws, text)
    names = {x: f"level_{i}" for i, x in enumerate(spec.levels)}
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(n) for x, n in names.items()))
    at = cuts.select(*(F.col(x).alias(n) for x, n in names.items()), "epochs", "cut")
    found = keyed.join(at, list(names.values()))
    more = F.coalesce((_key(spec, F.col("epochs")) <= F.col("cut")).cast("int"), F.lit(0))
    copies = found.select("row", (F.col("epochs") + more).alias("copies")).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def oracle(spec: MixSpec | None = None, domains: dict[str, str] | None = None) -> str:
    """DuckDB SQL for ``mix_sources`` over ``documents``."""
    spec, domains = spec or MixSpec(), domains or DOMAINS
    levels = list(spec.levels)
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in sorted(domains.items()))
    ctes = [
        f"""docs as (select doc_id, case coalesce(source, '') {cases} else 'other' end as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens from documents)""",
        f"leaves as (select {', '.join(levels)}, sum(tokens)::hugeint as tokens, sum(tokens)::hugeint * {spec.max_epochs} as cap from docs group by all)",
        f"b0 as (select least(sum(cap), sum(tokens) * {spec.budget_percent} // 100) as b from leaves)",
    ]
    for i, name in enumerate(levels):
        here, parent = ", ".join(levels[: i + 1]), levels[:i]
        known = spec.weights.get(name)
        w = f"case {name} {' '.join(f'when {k!r} then {v}' for k, v in sorted(known.items()))} else {spec.default_weight} end" if known else "1"
        join = f"join b{i} using ({', '.join(parent)})" if parent else f"cross join b{i}"
        part = f"partition by {', '.join(parent)}" if parent else ""
        ctes += [
            f"n{i} as (select {here}, sum(cap) as cap, {w} as w from leaves group by {here})",
            f"p{i} as (select *, coalesce(sum(cap) over ({part} order by cap::double / w, {name} rows between unbounded preceding and 1 preceding), 0) as prev, sum(w) over ({part} order by cap::double / w, {name} rows between current row and unbounded following) as wrem from n{i} {join})",
            f"q{i} as (select *, (b - prev) * w >= cap * wrem as sat from p{i})",
            f"r{i} as (select *, sum(case when sat then cap else 0 end) over ({part}) as taken, sum(case when sat then 0 else w end) over ({part}) as wopen from q{i})",
            f"t{i} as (select *, case when sat then 0 else (b - taken) * w // nullif(wopen, 0) end as base, case when sat then -1 else (b - taken) * w % nullif(wopen, 0) end as fraction from r{i})",
            f"u{i} as (select *, (b - taken) - sum(base) over ({part}) as extra, row_number() over ({part} order by fraction desc, {name}) as nth from t{i})",
            f"b{i + 1} as (select {here}, case when sat then cap else base + case when nth <= extra then 1 else 0 end end as b from u{i})",
        ]
    last, cols = f"b{len(levels)}", ", ".join(levels)
    ctes += [
        f"plan as (select {cols}, l.tokens as total, case when l.tokens > 0 then b // l.tokens else 1 end as epochs, case when l.tokens > 0 then b - (b // l.tokens) * l.tokens else 0 end as rest from leaves l join {last} using ({cols}))",
        f"keyed as (select d.*, epochs, rest, total, md5('{spec.seed}:' || epochs || ':' || coalesce(doc_id::varchar, '')) as key from docs d join plan using ({cols}))",
        f"run as (select *, sum(tokens) over (partition by {cols} order by key) as run from keyed)",
        "picked as (select *, epochs + case when total > 0 and rest > 0 and run <= rest then 1 else 0 end as copies from run)",
    ]
    return "with " + ",\n".join(ctes) + f"\nselect doc_id, {cols}, tokens::bigint as tokens, unnest(range(copies::bigint))::int as epoch from picked where copies > 0"
