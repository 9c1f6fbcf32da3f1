"""Parsers and enrichment. Customers and conversations are written as records and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.functions.text import json_text
from quarry.operators.datasets import filled, selected
from quarry.operators.lookup import build_lookup, exact_matches, nearest_matches
from quarry.plans.enrich import only_new, summarize_pairs
from quarry.queries.base import query, quoted
from quarry.sources.obo import entry_text, parse_terms, synonyms_of
from quarry.sources.records import links
from quarry.sources.soft import parse_samples, parse_series
from quarry.tables import table


@query("""select page_id, len(h)::bigint as n_links, coalesce(h[1], '') as first_link, coalesce(h[len(h)], '') as last_link from (select page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) as h from pages)""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select("page_id", links(F.col("html")).alias("h"))
    end = lambda i: F.coalesce(F.try_element_at("h", F.lit(i)), F.lit(""))
    return h.select("page_id", F.size("h").cast("long").alias("n_links"), end(1).alias("first_link"), end(-1).alias("last_link"))


def series_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series records of customers."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    lines = [
        F.concat(F.lit("^SERIES = GSE"), k),
        F.concat(F.lit("!Series_title = "), "c_name"),
        F.concat(F.lit("  !Series_summary = "), "c_mktsegment"),
        F.concat(F.lit("!Series_summary = about = "), "c_name"),
        F.lit("!Series_summary = "),
        F.concat(F.lit("!Series_type = "), "c_mktsegment"),
        F.when(k % 2 == 0, F.lit("!Series_type = Other")),
        F.concat(F.lit("!Series_pubmed_id = "), k % 7),
        F.lit("!Series_pubmed_id = 3"),
        F.lit("!Series_sample_id = GSM1"),
        F.when(k % 3 == 0, F.concat(F.lit("!Series_sample_count = "), k % 10)),
        F.when(k % 5 == 0, F.lit("!Series_sample_count = many")),
        F.lit("!Series_sample_id = GSM2"),
        F.lit("!Series_submission_date = Jan 01 2020"),
        F.concat(F.lit("!Series_submission_date = Feb 0"), k % 9, F.lit(" 2021")),
    ]
    return c.select(F.concat(F.lit("GSE"), k).alias("series_id"), F.concat_ws("\n", *lines).alias("text"))


@query("""select 'GSE' || c_custkey as series_id, c_name as title, c_mktsegment || ' about = ' || c_name as summary, c_mktsegment || case when c_custkey % 2 = 0 then '; Other' else '' end as series_type,
case when c_custkey % 7 = 3 then '3' else (c_custkey % 7) || ',3' end as pubmed_ids, 'Feb 0' || c_custkey % 9 || ' 2021' as submission_date, case when c_custkey % 3 = 0 then c_custkey % 10 + 1 else 2 end as n_samples from customer""")
def soft_series_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse_series(series_texts(spark, sf_dir))
    return out.select("series_id", "title", "summary", "series_type", F.array_join("pubmed_ids", ",").alias("pubmed_ids"), "submission_date", F.col("n_samples").cast("long").alias("n_samples"))


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample records of conversations: each turn of a user starts a sample."""
    c = table(spark, sf_dir, "conversations")
    head = F.when(F.col("role") == "user", F.concat(F.lit("^SAMPLE = GSM"), "conv_id", F.lit("_"), "turn"))
    line = F.concat_ws("\n", head, F.concat(F.lit("!Sample_title = "), "role"), F.concat(F.lit("!Sample_characteristics_ch1 = Tissue: "), "turn"), F.concat(F.lit("!Sample_characteristics_ch1 = kind="), "role"), F.concat(F.lit("!Sample_characteristics_ch1 = plain "), "turn"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return g.select(F.concat(F.lit("GSE"), "conv_id").alias("series_id"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


@query("""with s as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as section from conversations)
select 'GSE' || conv_id as series_id, 'GSM' || conv_id || '_' || min(turn) as sample_id, arg_max(role, turn) as title, max(turn)::varchar as tissue, arg_max(role, turn) as kind, 'plain ' || min(turn) as attr_0, count(*) + 2 as n_keys from s where section > 0 group by conv_id, section""")
def soft_sample_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = lambda k: F.try_element_at("characteristics", F.lit(k)).alias(k)
    return parse_samples(sample_texts(spark, sf_dir)).select("series_id", "sample_id", "title", ch("tissue"), ch("kind"), ch("attr_0"), F.size("characteristics").cast("long").alias("n_keys"))


def ontology_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    stanza = F.concat_ws(
        "\n",
        F.lit("[Term]"),
        F.concat(F.lit("id: "), F.when(k % 6 == 5, "XX:").otherwise("CL:"), k),
        F.concat(F.lit("name: "), "n_name"),
        F.concat(F.lit('synonym: "'), F.lower("n_name"), F.lit(' land" EXACT []')),
        F.concat(F.lit('synonym: "region '), "n_regionkey", F.lit('" RELATED []')),
        F.when(k % 5 == 4, F.lit("is_obsolete: true")),
        F.when(k % 3 == 0, F.concat(F.lit("\n[Typedef]\nid: CL:9"), k, F.lit("\nname: part of"))),
        F.lit(""),
    )
    g = n.groupBy().agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), stanza.alias("s")))).alias("x"))
    return g.select(F.lit("CL").alias("onto"), F.concat(F.lit("format-version: 1.2\n\n"), F.array_join(F.transform("x", lambda x: x["s"]), "\n")).alias("text"))


_TERMS = "terms as (select 'CL:' || n_nationkey as id, n_name as name, lower(n_name) || ' land' as syn, 'region ' || n_regionkey as region, n_nationkey as k from nation where n_nationkey % 6 != 5 and n_nationkey % 5 != 4)"


@query(f"with {_TERMS} select id, name, name || ': ' || syn || ', ' || region as entry from terms")
def obo_stanzas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_terms(ontology_text(spark, sf_dir)).select("id", "name", entry_text(F.col("name"), F.col("synonyms")).alias("entry"))


@query(f"with {_TERMS} select lower(name) as key, id from terms union all select syn, id from terms union all select region, arg_min(id, k) from terms group by region")
def lookup_build_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = parse_terms(ontology_text(spark, sf_dir))
    return build_lookup(terms, synonyms_of(terms)).select("key", "id")


@query(f"""with {_TERMS}, l as (select lower(name) as key, id, name from terms union all select syn, id, name from terms),
w as (select distinct category, raw from (select case c_custkey % 2 when 0 then 'cell_type' else 'tissue' end as category, case c_custkey % 3 when 0 then '  ' || upper(n_name) when 1 then n_name || ' Land' else 'none of ' || n_name end as raw from customer join nation on c_nationkey = n_nationkey))
select category, raw, l.id, l.name as onto_name, case when l.id is null then 'none' else 'exact' end as method from w left join l on lower(trim(raw)) = key and category = 'cell_type'""")
def ontology_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = parse_terms(ontology_text(spark, sf_dir))
    c, k = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper("n_name"))).when(k % 3 == 1, F.concat("n_name", F.lit(" Land"))).otherwise(F.concat(F.lit("none of "), "n_name"))
    wanted = c.select(F.when(k % 2 == 0, "cell_type").otherwise("tissue").alias("category"), raw.alias("raw"))
    return exact_matches(wanted, build_lookup(terms, synonyms_of(terms)), terms).select("category", "raw", "id", "onto_name", "method")


_COS = "round(list_dot_product(a.embedding::double[], b.embedding::double[]) / ((sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) + 1e-10) * (sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-10)), 9)"


@query(f"""select a.vec_id as raw, b.vec_id as id, {_COS} as score from embeddings a, embeddings b where a.label = 0 and b.label != 0 and {_COS} >= 0.3 qualify row_number() over (partition by a.vec_id order by score desc, b.vec_id) = 1""")
def ontology_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    wanted = e.where("label = 0").select(F.col("vec_id").alias("raw"), F.col("embedding").alias("vec"))  # the terms without an exact match
    return nearest_matches(wanted, e.where("label != 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.3)


_FAMILY = {"click": "tissue", "view": "disease", "purchase": "age", "signup": "donor"}


@query(f"""with p as (select user_id, case event_type {' '.join(f"when {quoted(k)} then {quoted(v)}" for k, v in _FAMILY.items())} else 'sex' end as family, 'V' || (event_id % 11) || ' years' as value from events)
select user_id, coalesce(string_agg(distinct lower(value), ',' order by lower(value)) filter (family = 'tissue'), '') as tissues, coalesce(string_agg(distinct lower(value), ',' order by lower(value)) filter (family = 'disease'), '') as diseases,
coalesce(string_agg(distinct lower(value), ',' order by lower(value)) filter (family = 'sex'), '') as sex, count(distinct value) filter (family = 'donor') as donor_count,
coalesce((min(regexp_extract(value, '(\\d+)', 1)::int) filter (family = 'age')) || '-' || (max(regexp_extract(value, '(\\d+)', 1)::int) filter (family = 'age')), '') as age_range from p group by user_id""")
def characteristics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    family = F.lit("sex")
    for k, v in _FAMILY.items():
        family = F.when(F.col("event_type") == k, v).otherwise(family)
    pairs = e.select("user_id", family.alias("family"), F.concat(F.lit("V"), F.col("event_id") % 11, F.lit(" years")).alias("value"))
    out = summarize_pairs(pairs, "user_id")
    return out.select("user_id", *(F.array_join(c, ",").alias(c) for c in ("tissues", "diseases", "sex")), F.col("donor_count").cast("long").alias("donor_count"), "age_range")


@query("""select o_orderkey, coalesce(nullif(case when o_orderkey % 3 = 0 then '' else c_name end, ''), n_name, r_name, '') as title, coalesce(n_name, '') as organism, coalesce(nullif(o_orderstatus, 'O'), c_mktsegment) as series_type
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def enrich_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    x = x.withColumn("own", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("c_name"))).withColumn("none", F.lit(""))
    return x.select("o_orderkey", filled("own", "n_name", "r_name").alias("title"), filled("none", "n_name").alias("organism"), F.coalesce(F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), "c_mktsegment").alias("series_type"))


@query("select c_custkey from customer anti join (select o_custkey from orders where o_orderstatus = 'P' or o_totalprice > 300000) on c_custkey = o_custkey")
def existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' or o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return only_new(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("select o_orderkey, o_custkey from orders semi join (select c_custkey from customer where c_mktsegment = 'BUILDING') on o_custkey = c_custkey")
def selected_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selected(table(spark, sf_dir, "orders"), wanted, "o_custkey").select("o_orderkey", "o_custkey")


@query("""select event_id, case event_id % 4 when 3 then null else '{"id": ' || event_id || ', "t": "' || event_type || '"}' end as json from events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    obj = F.concat(F.lit('{"id": '), k, F.lit(', "t": "'), "event_type", F.lit('"}'))
    answer = F.when(k % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```\n"))).when(k % 4 == 1, F.concat(F.lit("It is "), obj, F.lit(" as asked."))).when(k % 4 == 2, obj).otherwise("no { object")
    return e.select("event_id", json_text(answer).alias("json"))


@query(f"select d.doc_id, d.lang, {quoted(', '.join(lexicon.FIELD_ONTOLOGIES))} as fields from documents d where d.lang = 'fr' and d.source = 'src1'")
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.plans.retrieve import equality

    d = table(spark, sf_dir, "documents").where(equality({"lang": "fr", "source": "src1"}))
    return d.select("doc_id", "lang", F.lit(", ".join(lexicon.FIELD_ONTOLOGIES)).alias("fields"))
