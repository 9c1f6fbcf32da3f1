"""Manifests, gaps, layouts, matrices, evaluation and model plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scoring import mcq_letter, number, says_yes, token_f1
from quarry.operators.matrix import merge_samples, needs_transpose, quality_filter, wide_to_rows
from quarry.operators.datasets import uncovered
from quarry.operators.ranking import make_unique, top_per_group
from quarry.plans.evaluate import category_composites, dataset_results, open_runs, score_items
from quarry.plans.models import build_plan, memory_fit, plan_totals
from quarry.plans.reports import download_states, link_report, manifest_files, manifest_summary, series_status, themes
from quarry.queries.base import CLASSIFIED_SQL, files, query
from quarry.tables import table


@query(f"""with {CLASSIFIED_SQL} select series_id, count(*) as total_local_files, count(*) filter (is_count_matrix) as count_matrix_files, bool_or(ends_with(file_name, '.h5ad')) as has_h5ad,
bool_or(contains(file_name, '.h5') or contains(file_name, 'matrix.mtx')) as has_h5_or_mtx, count(*) filter (pos % 2 = 0) as files_with_source from classified group by series_id""")
def manifest_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    local = f.select("series_id", F.col("url").alias("name"), "size_bytes")
    remote = f.where("pos % 2 = 0").select("series_id", "pos", F.concat(F.lit("https://x/"), "url").alias("url"))
    return manifest_summary(manifest_files(local, remote.unionByName(remote.withColumn("pos", F.col("pos") + 1))))


@query(f"""with {CLASSIFIED_SQL} select series_id, url as name, size_bytes, format_type, processing_level, is_count_matrix, case when pos % 2 = 0 then 'https://x/' || url else '' end as source_url from classified""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    remote = f.where("pos % 2 = 0").select("series_id", "pos", F.concat(F.lit("https://x/"), "url").alias("url"))
    rows = manifest_files(f.select("series_id", F.col("url").alias("name"), "size_bytes"), remote)
    return rows.select("series_id", "name", "size_bytes", "format_type", "processing_level", "is_count_matrix", "source_url")


@query("""with t as (select p_partkey, case p_size % 3 when 0 then 'lung' when 1 then 'kidney' else 'unknown' end as organ, case p_size % 4 when 0 then 'cancer' when 1 then 'development' else 'unknown' end as domain from part)
select domain, organ, count(*) as series from t group by all""")
def theme_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_size")
    series = p.select(
        F.col("p_partkey").alias("series_id"),
        F.when(k % 4 == 0, "tumor carcinoma").when(k % 4 == 1, "embryo").otherwise("").alias("title"),
        F.when(k % 3 == 0, "Pulmonary and renal").when(k % 3 == 1, "adrenal tissue").otherwise("nothing").alias("summary"),
        F.lit(None).cast("string").alias("overall_design"),
    )
    return themes(series).groupBy("domain", "organ").agg(F.count("*").alias("series"))


@query("select n_name from nation except select n_name from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 5000")
def gap_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    covered = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name")
    return uncovered(n.select("n_name"), covered, "n_name")


@query("""select n_name, c_custkey, row_number() over (partition by n_name order by c_acctbal desc, c_custkey)::bigint as rank from nation join customer on c_nationkey = n_nationkey
where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000) and c_mktsegment != 'BUILDING' qualify rank <= 5""")
def gap_topn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    missing = uncovered(table(spark, sf_dir, "nation"), covered, "n_nationkey")
    good = table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'").join(missing, F.col("c_nationkey") == F.col("n_nationkey"))
    best = top_per_group(good, ["n_name"], [F.desc("c_acctbal"), "c_custkey"], 5)
    return best.select("n_name", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""with s as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag != 'R') as good from lineitem group by l_orderkey), t as (select case when good = n then 'complete' when good > 0 then 'partial' else 'failed' end as status from s)
select count(*) filter (status = 'complete') as complete, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'no_files') as no_files, count(*) as total from t""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series_id"), (F.col("l_returnflag") != "R").alias("ok"))
    return download_states(series_status(rows))


@query("""select regexp_extract(url, '^https?://([^/]+)', 1) as host, count(*) as links, count(*) filter (page_id % 3 != 0) as accessible_links, coalesce(sum(length(html)) filter (page_id % 3 != 0), 0)::bigint as total_size from pages group by host""")
def link_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), (F.col("page_id") % 3 != 0).alias("accessible"), F.length("html").cast("long").alias("size"))
    return link_report(p, ["host"]).drop("size_text")


@query("""with x as (select l_orderkey as cell, case when l_partkey % 200 < 20 then 'MT-' || l_partkey % 200 else 'g' || l_partkey % 200 end as gene, sum(l_quantity)::bigint as value from lineitem group by all),
a as (select * from x where cell in (select cell from x group by cell having count(*) >= 3)), b as (select * from a where gene in (select gene from a group by gene having count(*) >= 20)),
k as (select cell from b group by cell having 100.0 * sum(case when starts_with(gene, 'MT-') then value else 0 end) / sum(value) < 20) select cell, gene, value from b where cell in (select cell from k)""")
def matrix_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("l_partkey") % 200
    gene = F.when(g < 20, F.concat(F.lit("MT-"), g)).otherwise(F.concat(F.lit("g"), g))
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), gene.alias("gene")).agg(F.sum("l_quantity").cast("long").alias("value"))
    return quality_filter(m, 3, 20, 20.0)


@query("""select p_partkey, p_name || case when n > 0 then '-' || n else '' end as unique_name from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as n from part)""")
def matrix_make_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return make_unique(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey").select("p_partkey", "unique_name")


@query("select sample, gene, count(*) as cells, sum(value)::bigint as total from (select l_returnflag as sample, l_orderkey as cell, l_partkey % 50 as gene, l_quantity as value from lineitem) group by all")
def matrix_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("cell"), (F.col("l_partkey") % 50).alias("gene"), F.col("l_quantity").alias("value"))
    merged = merge_samples({s: rows.where(F.col("l_returnflag") == s).drop("l_returnflag") for s in ("A", "N", "R")})
    return merged.groupBy("sample", "gene").agg(F.count("*").alias("cells"), F.sum("value").cast("long").alias("total"))


@query("""with w as (select l_linenumber as cell, sum(l_quantity) filter (l_returnflag = 'A') as a, sum(l_quantity) filter (l_returnflag = 'N') as n, sum(l_quantity) filter (l_returnflag = 'R' and l_linenumber % 2 = 0) as r from lineitem group by cell)
select cell, gene, value::float::double as value from (select cell, 'a' as gene, a as value from w union all select cell, 'n', n from w union all select cell, 'r', r from w) where value != 0""")
def matrix_wide_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.sum(F.when(c, F.col("l_quantity")))
    flag = F.col("l_returnflag")
    wide = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(of(flag == "A").alias("a"), of(flag == "N").alias("n"), of((flag == "R") & (F.col("l_linenumber") % 2 == 0)).alias("r"))
    assert not needs_transpose(7, 3)
    return wide_to_rows(wide, "l_linenumber")


_ANSWERS = """case o_orderkey % 6 when 0 then 'B) because' when 1 then 'The answer is c' when 2 then 'none' when 3 then 'I pick D' when 4 then '#### 1,234 ' || o_orderkey else 'Yes, 3 then ' || o_custkey end"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = F.when(k % 6 == 0, "B) because").when(k % 6 == 1, "The answer is c").when(k % 6 == 2, "none").when(k % 6 == 3, "I pick D")
    a = a.when(k % 6 == 4, F.concat(F.lit("#### 1,234 "), k)).otherwise(F.concat(F.lit("Yes, 3 then "), "o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", a.alias("answer"))


@query(f"""select o_orderkey, coalesce(nullif(regexp_extract(t, '^([A-D])\\b', 1), ''), nullif(upper(regexp_extract(t, '(?i)(?:answer|correct)\\s*(?:is|:)\\s*([A-D])\\b', 1)), ''), regexp_extract(t, '\\b([A-D])\\s*$', 1)) as letter,
replace(case when contains(t, '####') then regexp_extract(t, '####\\s*([\\d,]+\\.?\\d*)', 1) else coalesce(list_last(regexp_extract_all(t, '[\\d,]+\\.?\\d*')), '') end, ',', '') as number,
list_contains(list_slice(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x != ''), 1, 3), 'yes') as says_yes from (select o_orderkey, {_ANSWERS} as t from orders join customer on o_custkey = c_custkey)""")
def answer_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("answer")
    some = _answers(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return some.select("o_orderkey", mcq_letter(a).alias("letter"), number(a).alias("number"), says_yes(a).alias("says_yes"))


@query("""with x as (select conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t != '')) as p, list_distinct(list_filter(string_split_regex(lower(coalesce(lag(text) over (partition by conv_id order by turn), '')), '\\s+'), lambda t: t != '')) as g from conversations)
select conv_id, turn, round(case when len(p) = 0 and len(g) = 0 then 1.0 when len(p) = 0 or len(g) = 0 or len(list_intersect(p, g)) = 0 then 0.0
else 2.0 * (len(list_intersect(p, g))::double / len(p)) * (len(list_intersect(p, g))::double / len(g)) / (len(list_intersect(p, g))::double / len(p) + len(list_intersect(p, g))::double / len(g)) end, 9) as f1 from x""")
def token_f1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.round(token_f1(F.col("text"), F.coalesce("before", F.lit(""))), 9).alias("f1"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as multiple-choice items: the length decides the answer."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    right = F.element_at(F.array(F.lit("A"), F.lit("B")), F.col("quality") + 1)
    said = F.when(F.col("n_chars") > 500, "B").when(F.col("n_chars") > 100, "The answer is a").otherwise("no idea")
    flip = F.col("doc_id") % 2 == 0
    return x.select(
        F.when(flip, "mcq_letter").otherwise("mcq_index").alias("evaluator"),
        F.lit("answer").alias("answer_field"),
        F.lit(0).alias("shift"),
        F.col("doc_id").alias("item_id"),
        F.when(flip, F.concat(F.lit('{"answer": "'), right, F.lit('"}'))).otherwise(F.concat(F.lit('{"answer": '), F.when(F.col("doc_id") % 7 == 1, F.lit(5)).otherwise(F.col("quality")), F.lit("}"))).alias("item"),
        said.alias("response"),
        F.col("source").alias("dataset"),
        F.col("lang").alias("category"),
    )


_SCORED = """s as (select source as dataset, lang as category, case when n_chars > 500 then 'B' when n_chars > 100 then 'A' else '' end = case quality when 0 then 'A' else 'B' end as correct
 from labels join documents using (doc_id) where not (doc_id % 2 = 1 and doc_id % 7 = 1)),
d as (select category, dataset, count(*) as n_samples, round(avg(correct::int), 4) as accuracy from s group by all)"""


@query(f"with {_SCORED} select category, dataset, n_samples, accuracy from d")
def eval_dataset_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_results(score_items(_items(spark, sf_dir)), ["category", "dataset"]).drop("avg_score")


@query(f"with {_SCORED} select category, round(avg(accuracy), 4) as composite, count(*) as datasets from d group by category")
def eval_accuracy_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_composites(dataset_results(score_items(_items(spark, sf_dir)), ["category", "dataset"]), ["category"])


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    models = p.select(
        F.concat(F.lit("m"), "p_partkey").alias("key"),
        F.concat(F.lit("m"), "p_partkey").alias("full_name"),
        F.col("p_brand").alias("family"),
        (F.col("p_size") % 4).alias("wave"),
        F.col("p_size").alias("size_b"),
        F.when(F.col("p_partkey") % 10 == 0, None).otherwise(F.col("p_size").cast("double") / 2).alias("vram_gb"),
        (F.col("p_partkey") % 3 != 0).alias("enabled"),
        (F.col("p_partkey") % 8 == 0).alias("cpu_spill"),
    )
    pulled = p.where("p_partkey % 4 = 1").select(F.concat(F.lit("m"), "p_partkey", F.lit(":latest")).alias("name"))
    return build_plan(models, pulled)


_PLAN = """plan as (select 'm' || p_partkey as key, p_brand as family, p_size % 4 as wave, p_partkey % 4 = 1 as pulled, case when p_partkey % 10 = 0 then null else p_size::double / 2 end as vram_gb,
 coalesce(case when p_partkey % 10 = 0 then null else p_size::double / 2 end, 5.0) as gb, p_partkey % 3 != 0 as enabled, p_partkey % 8 = 0 as spill from part)"""


@query(f"""with {_PLAN} select coalesce(wave, -1)::int as wave, coalesce(family, '') as family, grouping_id(wave, family)::bigint as level, count(*) as models, count(*) filter (pulled) as have, count(*) filter (enabled and not spill) as configs, sum(case when pulled then 0.0 else gb end) as missing_gb from plan group by rollup (wave, family)""")
def model_plan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan_totals(_models(spark, sf_dir))
    return out.select(F.coalesce("wave", F.lit(-1)).alias("wave"), F.coalesce("family", F.lit("")).alias("family"), F.col("level").cast("long").alias("level"), "models", "have", "configs", "missing_gb")


@query(f"with {_PLAN} select key, vram_gb, round(vram_gb / 24.5 * 100, 1) as percent, case when vram_gb / 24.5 * 100 <= 100 then 'OK' else 'OVER' end as fit from plan where enabled and not spill and vram_gb is not null")
def model_memory_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_fit(_models(spark, sf_dir).where("vram_gb is not null"))


@query("select distinct p_brand as model from part where p_brand not in (select p_brand from part where p_size = 1 and p_partkey % 3 = 0)")
def open_model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    done = p.where("p_size = 1 and p_partkey % 3 = 0").select(F.col("p_brand").alias("model"))
    return open_runs(p.select(F.col("p_brand").alias("model")).distinct(), done)
