"""Whole flows over landed files: records are written as the files of a source, read again and taken through the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.functions.text import failure_class, first_number
from quarry.operators.datasets import bucket_histogram, copies_needed
from quarry.operators.ranking import top_k
from quarry.operators.rules import organ_first, search_expression
from quarry.plans.acquire import verify_links
from quarry.plans.answer import envelope, fallback_answer, field_chunks, result_stats
from quarry.plans.convert import convert_folder, totals_by_series
from quarry.plans.enrich import enrich, long_characteristics, study_mappings
from quarry.plans.evaluate import category_composites, dataset_results, prompts, read_items, run_records, score_items
from quarry.plans.index import fallback_text, payload, upsert_index, write_index
from quarry.plans.models import build_plan, filter_plan, resolve_names
from quarry.plans.reports import organ_gaps
from quarry.plans.retrieve import RetrievalSpec, multi_step, search
from quarry.queries.base import files, query, quoted
from quarry.queries.retrieval import _ST, _overlap, _studies
from quarry.runtime import Workspace
from quarry.sources.hdf5_writer import write_matrices
from quarry.sources.matrices import newest, read_triplet, scan_folder, series_folders
from quarry.sources.obo import parse_terms, read_obo
from quarry.sources.records import accession_index, listed_files, read_articles, read_search, read_studies, read_summaries, series_hits, study_by_id
from quarry.sources.soft import parse_samples, select_accessions, supplementary_urls
from quarry.tables import table

_STRINGS = "array<string>"


def _text(*parts) -> F.Column:
    """One text of literals and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _land(df: DataFrame, text, name: str, block: int = 2000) -> str:
    """Write XML files of about ``block`` records below one root each, and return the folder."""
    ws = Workspace(df.sparkSession, "landed")
    blocks = max(1, -(-df.count() // block))
    rows = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).alias("block"), text.alias("t"))
    whole = rows.groupBy("block").agg(F.concat(F.lit("<Set>"), F.array_join(F.collect_list("t"), "\n"), F.lit("</Set>")).alias("value"))
    whole.repartition("block").write.partitionBy("block").text(f"{ws.root}/{name}")
    return f"{ws.root}/{name}"


# ---- records


@query("""select p_partkey::varchar as pmid, p_name as title, 'AIM: ' || p_type || ' ' || p_brand as abstract, case when p_partkey % 3 = 0 then '' else p_type || '|size ' || p_size end as mesh, case when p_partkey % 2 = 0 then p_brand else '' end as keywords from part""")
def article_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    mesh = _text("<MeshHeadingList><MeshHeading><DescriptorName>", F.col("p_type"), "</DescriptorName></MeshHeading><MeshHeading><DescriptorName>size ", F.col("p_size"), "</DescriptorName></MeshHeading></MeshHeadingList>")
    words = _text("<KeywordList><Keyword>", F.col("p_brand"), "</Keyword></KeywordList>")
    xml = _text(
        "<PubmedArticle><MedlineCitation><PMID>", k, "</PMID><Article><ArticleTitle>", F.col("p_name"), '</ArticleTitle><Abstract><AbstractText Label="AIM">', F.col("p_type"), "</AbstractText><AbstractText>",
        F.col("p_brand"), "</AbstractText></Abstract></Article>", F.when(k % 3 == 0, "").otherwise(mesh), F.when(k % 2 == 0, words).otherwise(""), "</MedlineCitation></PubmedArticle>",
    )
    got = read_articles(spark, _land(p, xml, "articles"))
    return got.select("pmid", "title", "abstract", F.array_join("mesh_terms", "|").alias("mesh"), F.array_join("keywords", "|").alias("keywords"))


def summary_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search summaries of orders: a customer's orders are hits of one series, all alike."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    own = F.when(k % 4 == 0, _text('<Item Name="Accession" Type="String">GSE', k, "</Item>")).when(k % 4 == 1, '<Item Name="entryType" Type="String">GSE</Item>').when(k % 4 == 2, _text('<Item Name="Relation" Type="String">part of GSE', k, "</Item>")).otherwise("")
    uid = F.when(k % 4 == 3, _text("200", k)).otherwise(k.cast("string"))
    xml = _text(
        "<DocSum><Id>", uid, "</Id>", own, '<Item Name="title" Type="String">study ', k, '</Item><Item Name="taxon" Type="String">human</Item><Item Name="n_samples" Type="Integer">', k % 50,
        '</Item><Item Name="PubMedIds" Type="List"><Item Name="int" Type="Integer">', k + 1, '</Item><Item Name="int" Type="Integer">', k + 2, "</Item></Item></DocSum>",
    )
    return o.select(k, xml.alias("xml"))


@query("""select case when o_custkey % 4 = 3 then '200' else '' end || o_custkey as uid, count(*) as hits, 'study ' || o_custkey as title, o_custkey % 50 as n_samples, (o_custkey + 1) || ',' || (o_custkey + 2) as articles from orders group by o_custkey""")
def summary_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_summaries(spark, _land(summary_xml(spark, sf_dir), F.col("xml"), "summaries"))
    row = got.select("uid", F.col("strings")["title"].alias("title"), F.col("integers")["n_samples"].cast("long").alias("n_samples"), F.array_join(F.col("lists")["PubMedIds"], ",").alias("articles"))
    return row.groupBy("uid", "title", "n_samples", "articles").agg(F.count("*").alias("hits"))


@query("""select 'GSE' || o_custkey as series_id, 'study ' || o_custkey as title, 'human' as organism, o_custkey % 50 as n_samples, (o_custkey + 1) || ',' || (o_custkey + 2) as articles from (select distinct o_custkey from orders) where o_custkey % 50 >= 3""")
def series_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.engine import Engine

    got = Engine(spark).search_series(_land(summary_xml(spark, sf_dir), F.col("xml"), "summaries"), min_samples=3)
    return got.select("series_id", "title", "organism", F.col("n_samples").cast("long").alias("n_samples"), F.array_join("pubmed_ids", ",").alias("articles"))


@query("select n_nationkey::bigint + 10 as count, case when n_nationkey % 4 = 0 then '' else n_nationkey || ',' || (n_nationkey + 100) end as ids, 'ENV_' || n_nationkey as web_env, case when n_nationkey % 2 = 0 then '1' else '' end as query_key from nation")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    ids = F.when(k % 4 == 0, "<IdList></IdList>").otherwise(_text("<IdList><Id>", k, "</Id><Id>", k + 100, "</Id></IdList>"))
    xml = _text("<eSearchResult><Count>", k + 10, "</Count>", F.when(k % 2 == 0, "<QueryKey>1</QueryKey>").otherwise(""), "<WebEnv>ENV_", k, "</WebEnv>", ids, "</eSearchResult>")
    return read_search(spark, _land(table(spark, sf_dir, "nation"), xml, "search")).withColumn("ids", F.array_join("ids", ","))


@query("""select c_custkey, '(' || coalesce(case when c_custkey % 5 = 0 then null else c_name end, 'single cell RNA-seq') || ')' || case when c_custkey % 2 = 0 then ' AND "' || c_mktsegment || '"[Organism]' else '' end || case when c_custkey % 3 = 0 then ' AND "kind ' || c_nationkey || '"[DataSet Type]' else '' end as expression from customer""")
def search_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = search_expression(F.when(k % 5 != 0, F.col("c_name")), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.when(k % 3 == 0, _text("kind ", F.col("c_nationkey"))))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("expression"))


@query("""with f as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos from orders where o_orderkey % 5 != 0)
select 'GSE' || o_custkey as series_id, pos, 'file_' || o_orderkey || '.txt.gz' as name from f""")
def listed_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    anchor = _text('<a href="', F.when(F.col("o_orderkey") % 5 == 0, "/geo/").otherwise(_text("file_", F.col("o_orderkey"), ".txt.gz")), '">x</a>')
    pages = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", anchor.alias("a")))), lambda x: x["a"]), "\n").alias("html"))
    got = listed_files(pages.select(_text("GSE", F.col("o_custkey")).alias("series_id"), "html"))
    return got.select("series_id", F.col("pos").cast("long").alias("pos"), F.substring_index("url", "/", -1).alias("name"))


def _sample_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of customers: their orders, with characteristics and files."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    lines = F.concat_ws(
        "\n",
        _text("^SAMPLE = GSM", k),
        _text("!Sample_title = sample ", k),
        F.concat(F.lit("!Sample_source_name_ch1 = "), F.when(k % 4 == 0, "None").otherwise(F.col("o_orderpriority"))),
        F.lit("!Sample_organism_ch1 = Homo sapiens"),
        _text("!Sample_characteristics_ch1 = Disease State: ", F.when(k % 3 == 0, "N/A").otherwise(F.concat(F.lit("Status "), "o_orderstatus"))),
        _text("!Sample_characteristics_ch1 = age: ", k % 60, " years"),
        _text("!Sample_characteristics_ch1 = donor: d", k % 7),
        F.when(k % 2 == 0, _text("!Sample_supplementary_file = ftp://x/GSM", k, "_a.h5")).otherwise("!Sample_supplementary_file = NONE"),
    )
    x = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", lines.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return x.select(_text("GSE", F.col("o_custkey")).alias("series_id"), "text")


@query("select 'GSE' || o_custkey as series_id, 'ftp://x/GSM' || o_orderkey || '_a.h5' as url from orders where o_orderkey % 2 = 0")
def sample_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplementary_urls(_sample_soft(spark, sf_dir)).select("series_id", "url")


@query("""select 'GSE' || o_custkey as series_id, 'tissue' as family, o_orderpriority as value from orders where o_orderkey % 4 != 0
union all select 'GSE' || o_custkey, 'organism', 'Homo sapiens' from orders
union all select 'GSE' || o_custkey, 'disease', 'Status ' || o_orderstatus from orders where o_orderkey % 3 != 0
union all select 'GSE' || o_custkey, 'age', (o_orderkey % 60) || ' years' from orders
union all select 'GSE' || o_custkey, 'donor', 'd' || o_orderkey % 7 from orders""")
def characteristic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_characteristics(parse_samples(_sample_soft(spark, sf_dir))).select("series_id", "family", "value")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of customers: their orders are samples, parts their articles; every third has its title in the manifest."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    sid = _text("GSE", k).alias("series_id")
    series = c.select(
        sid,
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Lung "), "c_name")).alias("title"),
        F.when(k % 2 == 0, "tumor cells").otherwise("").alias("summary"),
        F.lit("").alias("overall_design"),
        F.when(k % 5 == 0, "Mus musculus").otherwise("").alias("organism"),
        F.lit("GPL1").alias("platform"),
        F.lit("").alias("series_type"),
        F.array(k.cast("string"), F.lit("x")).alias("pubmed_ids"),
        F.lit("2020").alias("submission_date"),
        (k % 2).cast("int").alias("n_samples"),
    )
    p = table(spark, sf_dir, "part")
    articles = p.select(F.col("p_partkey").cast("string").alias("pmid"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.array("p_brand").alias("mesh_terms"), F.array().cast(_STRINGS).alias("keywords"))
    manifest = c.where(k % 7 != 0).select(sid, F.concat(F.lit("Local "), "c_name").alias("title"), F.lit("kept here").alias("summary"), F.col("c_mktsegment").alias("series_type"))
    return enrich(series, parse_samples(_sample_soft(spark, sf_dir)), articles, manifest)


@query("""with s as (select o_custkey, count(*) as n, string_agg(distinct lower(o_orderpriority), ',' order by lower(o_orderpriority)) filter (o_orderkey % 4 != 0) as tissues,
  string_agg(distinct 'status ' || lower(o_orderstatus), ',' order by 'status ' || lower(o_orderstatus)) filter (o_orderkey % 3 != 0) as diseases, count(distinct o_orderkey % 7) as donors, min(o_orderkey % 60) || '-' || max(o_orderkey % 60) as ages from orders group by o_custkey),
x as (select *, case when c_custkey % 3 != 0 then 'Lung ' || c_name when c_custkey % 7 != 0 then 'Local ' || c_name else '' end as title, case when c_custkey % 2 = 0 then 'tumor cells' when c_custkey % 7 != 0 then 'kept here' else '' end as summary
  from customer left join s on o_custkey = c_custkey)
select 'GSE' || c_custkey as gse_id, title, summary, case when c_custkey % 7 != 0 then c_mktsegment else '' end as series_type, case when c_custkey % 5 = 0 then 'Mus musculus' when n is not null then 'Homo sapiens' else '' end as organism,
  case when c_custkey % 2 = 1 then 1 else coalesce(n, 0) end as n_samples, coalesce(tissues, '') as tissues, coalesce(diseases, '') as diseases, coalesce(donors, 0) as donor_count, coalesce(ages, '') as age_range, p_name as article,
  case when c_custkey % 2 = 0 then 'cancer' else '' end as domain, 'Study: ' || title || chr(10) || 'Organism: ' || case when c_custkey % 5 = 0 then 'Mus musculus' when n is not null then 'Homo sapiens' else '' end as head
from x left join part on p_partkey = c_custkey""")
def enriched_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = enriched(spark, sf_dir)
    long = lambda c: F.col(c).cast("long").alias(c)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return e.select("gse_id", "title", "summary", "series_type", "organism", long("n_samples"), joined("tissues"), joined("diseases"), long("donor_count"), "age_range", F.col("pubmed.title").alias("article"), "domain", F.substring_index("document_text", "\n", 2).alias("head"))


@query("select 'GSE7' as gse_id, 'Lung ' || c_name as title, 'kept here' as summary, 1::bigint as n_samples from customer where c_custkey = 7 and c_custkey % 7 != 0 union all select 'GSE7', 'Lung ' || c_name, '', 1 from customer where c_custkey = 7 and c_custkey % 7 = 0")
def enriched_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study_by_id(enriched(spark, sf_dir), "GSE7").select("gse_id", "title", "summary", F.col("n_samples").cast("long").alias("n_samples"))


@query("""select 'GSE' || c_custkey as gse_id, c_name as title, c_custkey % 9 as n_samples, case when c_custkey % 2 = 0 then 'lung,skin' else c_mktsegment end as tissues, case c_custkey % 3 when 0 then 'first' when 1 then 'only' else '' end as article from customer""")
def study_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies as arrays in JSON files, nested and flat, with a broken file beside them."""
    k = F.col("c_custkey")
    pub = F.when(k % 3 == 0, ', "pubmed": [{"title": "first"}, {"title": "second"}]').when(k % 3 == 1, ', "pubmed": {"title": "only"}').otherwise(', "pubmed": null')
    terms = F.when(k % 2 == 0, '"characteristics_summary": {"tissues": ["lung", "skin"]}').otherwise(_text('"tissues": ["', F.col("c_mktsegment"), '"]'))
    one = _text('{"gse_id": "GSE', k, '", "title": "', F.col("c_name"), '", ', F.when(k % 2 == 0, '"n_samples": ').otherwise('"sample_count": '), k % 9, ", ", terms, pub, "}")
    ws = Workspace(spark, "studies")
    arrays = table(spark, sf_dir, "customer").groupBy(F.expr("c_custkey div 500").alias("block")).agg(_text("[", F.array_join(F.collect_list(one), ","), "]").alias("value"))
    arrays.repartition("block").write.partitionBy("block").text(f"{ws.root}/studies")
    ws.put("studies/block=bad/broken.json", '{"gse_id": "GSE')
    got = read_studies(spark, f"{ws.root}/studies")
    return got.select("gse_id", "title", F.col("n_samples").cast("long").alias("n_samples"), F.array_join("tissues", ",").alias("tissues"), F.coalesce(F.col("pubmed.title"), F.lit("")).alias("article"))


@query("select 'GSE' || o_custkey as series_id from orders where o_custkey % 2 = 0 union select 'GSEx' || o_custkey from orders where o_custkey % 2 = 1 union select 'GSE' || o_orderkey || 'd' from orders where o_custkey % 2 = 1")
def accession_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    named = _text('{"gse_folder_index": {"GSE', c, '": "a"}, "GSE0": 1}')
    deep = _text('{"GSEx', c, '": 1, "other": {"GSE', k, 'd": 2, "no": 3}}')
    return accession_index(table(spark, sf_dir, "orders").select(F.when(c % 2 == 0, named).otherwise(deep).alias("value")))


@query("select distinct 'GSE' || upper(o_orderstatus) || o_custkey % 100 as series_id from orders where o_orderkey % 3 != 0")
def valid_accessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, "x1").otherwise(_text(" gse", F.lower("o_orderstatus"), F.col("o_custkey") % 100, "\t"))
    return select_accessions(o.select(raw.alias("id")))


# ---- folders


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """Small files of series, as many as there are nations."""
    ws = Workspace(spark, "folder")
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25 rows
        end = ("matrix.mtx", "barcodes.tsv", "counts.csv", "data.h5ad", "fragments.tsv")[r.n_nationkey % 5]
        ws.put(f"data/gse{r.n_regionkey}_x/n{r.n_nationkey}_{end}", "x" * (r.n_nationkey + 1))
    ws.put("data/gse0_x/conversion_summary.json", "{}")
    return f"{ws.root}/data"


@query("""select 'GSE' || n_regionkey as series_id, 'n' || n_nationkey || '_' || (['matrix.mtx', 'barcodes.tsv', 'counts.csv', 'data.h5ad', 'fragments.tsv'])[1 + n_nationkey % 5] as name, n_nationkey::bigint + 1 as length from nation where n_nationkey % 5 != 4""")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_folder(spark, _folder(spark, sf_dir))
    ids = series_folders(found.select(F.col("folder").alias("path")).distinct()).select("series_id", F.explode("paths").alias("folder"))
    return found.join(ids, "folder").select("series_id", "name", "length")


@query("select 'GSE' || c_nationkey as series_id, 's' || max(lpad(c_custkey::varchar, 9, '0')) as path from customer group by c_nationkey")
def newest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return newest(c.select(_text("GSE", F.col("c_nationkey")).alias("series_id"), _text("s", F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("path"), F.col("c_custkey").alias("mtime")), "series_id")


@query("""with s as (select 'GSE' || (s_nationkey % 2 + 1) as series_id, s_suppkey::varchar as cell, s_acctbal::float::double as a, s_nationkey::double as b from supplier)
select series_id, cell, 'balance' as gene, a as value from s where a != 0 union all select series_id, cell, 'nation, "key"', b from s where b != 0""")
def converted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tables of two series, one with tabs and one with commas and quotes, through the conversion of folders."""
    ws = Workspace(spark, "tables")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias('nation, "key"'))
    for n, sep, ending in ((0, ",", "csv"), (1, "\t", "tsv")):
        part = s.where(F.col('nation, "key"') % 2 == n)
        part.write.option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", True).option("extension", ending).csv(f"{ws.root}/in/GSE{n + 1}")
    return convert_folder(spark, f"{ws.root}/in")[0].select("series_id", "cell", "gene", "value")


@query("""select 'GSE' || l_suppkey as series_id, l_orderkey::varchar as cell, l_partkey::varchar as gene, sum(l_quantity)::double as value from lineitem group by all having sum(l_quantity) != 0""")
def hdf5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as HDF5 matrices of their suppliers, through the conversion of folders."""
    ws = Workspace(spark, "hdf5-files")
    rows = table(spark, sf_dir, "lineitem").select(_text("GSE", F.col("l_suppkey")).alias("series_id"), F.col("l_orderkey").cast("string").alias("cell"), F.col("l_partkey").cast("string").alias("gene"), F.col("l_quantity").cast("double").alias("value"))
    ws.save(write_matrices(rows, f"{ws.root}/in"), "written")
    return convert_folder(spark, f"{ws.root}/in")[0].select("series_id", "cell", "gene", "value")


@query("""select 'cell ' || r_name as cell, case when n_nationkey % 2 = 0 then n_name else 'ID' || n_nationkey end as gene, (n_nationkey + 1)::double as value from nation join region on n_regionkey = r_regionkey""")
def triplet_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    r = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    ws = Workspace(spark, "triplet")
    column = {x.r_regionkey: i + 1 for i, x in enumerate(r)}
    entries = "".join(f"{i + 1} {column[x.n_regionkey]} {x.n_nationkey + 1}\n" for i, x in enumerate(n))
    matrix = ws.put("matrix.mtx", f"%%MatrixMarket matrix coordinate real general\n%\n{len(n)} {len(r)} {len(n)}\n{entries}")
    barcodes = ws.put("barcodes.tsv", "".join(f"cell {x.r_name}\n" for x in r))
    features = ws.put("features.tsv", "".join(f"ID{x.n_nationkey}\t{x.n_name if x.n_nationkey % 2 == 0 else ''}\n" for x in n))
    return read_triplet(spark, matrix, barcodes, features).select("cell", "gene", "value")


@query("""select case n_nationkey % 3 when 0 then 'CL' when 1 then 'UBERON' else 'MONDO' end as onto, case n_nationkey % 3 when 0 then 'CL' when 1 then 'UBERON' else 'MONDO' end || ':' || n_nationkey as id, n_name as name from nation""")
def ontology_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "ontologies")
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    for i, (file, onto) in enumerate((("cl.obo", "CL"), ("uberon-basic.obo", "UBERON"), ("Mondo.obo", "MONDO"), ("other.obo", "XX"))):
        ws.put(f"obo/{file}", "format-version: 1.2\n\n" + "".join(f"[Term]\nid: {onto}:{x.n_nationkey}\nname: {x.n_name}\n\n" for x in n if x.n_nationkey % 3 == i or i == 3))
    return parse_terms(read_obo(spark, f"{ws.root}/obo")).select("onto", "id", "name")


class _Numbers:
    """A fetcher that answers by the number at a url's end."""

    def probe(self, url: str) -> tuple[int, int | None]:
        n = int(url.rsplit("_", 1)[1])
        if n % 7 == 3:
            raise OSError("no route")
        return (404 if n % 5 == 0 else 200), (n * 10 if n % 2 else None)

    def read(self, url: str, offset: int):
        yield b""


@query("""select o_orderkey, case when o_orderkey % 7 = 3 then 0 when o_orderkey % 5 = 0 then 404 else 200 end::bigint as status_code, o_orderkey % 7 != 3 and o_orderkey % 5 != 0 as accessible, case when o_orderkey % 7 != 3 and o_orderkey % 2 = 1 then o_orderkey * 10 else -1 end as size,
case when o_orderkey % 7 = 3 then 'no route' when o_orderkey % 5 = 0 then 'HTTP 404' else '' end as error from orders""")
def link_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", _text("https://x/f_", F.col("o_orderkey")).alias("url"))
    return verify_links(o, _Numbers()).drop("url").withColumns({"status_code": F.col("status_code").cast("long"), "size": F.coalesce("size", F.lit(-1))})


@query("""with f as (select 'GSE' || o_custkey as series_id, (['h5ad', 'h5', 'mtx', 'tar', 'csv_tsv', 'loom', 'other'])[1 + o_orderkey % 7] as bucket from orders) select series_id, bucket, count(*) as files from f group by all""")
def file_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*(F.lit(x) for x in (".h5ad", ".h5", "_matrix.mtx.gz", "_RAW.tar", "_counts.csv.gz", ".loom", ".pdf")))
    o = table(spark, sf_dir, "orders")
    return bucket_histogram(o.select(_text("GSE", F.col("o_custkey")).alias("series_id"), _text("f", F.col("o_orderkey"), F.element_at(ends, (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("url")))


@query("select 'GSE' || c_custkey as series_id, 'out/' || c_custkey as path, 'GSE' || c_custkey || '/GSE' || c_custkey || '.h5ad' as target from customer where c_custkey % 3 != 0")
def canonical_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    chosen = c.select(_text("GSE", k).alias("series_id"), _text("out/", k).alias("path"), (k * 3).alias("size_bytes"))
    present = c.where(k % 3 != 1).select(_text("GSE", k).alias("series_id"), F.when(k % 3 == 0, k * 3).otherwise(k * 3 + 1).alias("size_bytes"))
    return copies_needed(chosen, present).select("series_id", "path", "target")


@query("""with s as (select c_nationkey, max(case when c_custkey % 4 != 0 then c_custkey % 9 else 0 end) as most from customer group by c_nationkey)
select count(*) as total, count(*) filter (most > 0) as success, count(*) filter (most = 0) as failed, count(*) filter (most > 0) as outputs from s""")
def conversion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    done = table(spark, sf_dir, "customer").select(_text("GSE", F.col("c_nationkey")).alias("series_id"), F.when(k % 4 != 0, k % 9).otherwise(0).alias("entries"))
    return totals_by_series(done).withColumn("outputs", F.size("outputs").cast("long"))


# ---- index, retrieval and answers


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _studies(spark, sf_dir)
    return s.withColumns({"platform": F.lit("GPL1"), "series_type": F.lit("t"), "n_samples": F.col("donor_count"), "submission_date": F.lit("2020")})


@query(f"""with {_ST} select gse_id, case when s_suppkey % 2 = 0 then title || ' again' else title end as title, coalesce(organism, '') as organism from st where s_suppkey % 5 != 4 or s_suppkey % 2 = 0""")
def index_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "index")
    rows = payload(_stored(spark, sf_dir))
    number = F.substring("gse_id", 4, 20).cast("long")
    write_index(rows.where(number % 5 != 4), f"{ws.root}/old")
    again = rows.where(number % 2 == 0).withColumn("title", F.concat("title", F.lit(" again")))
    return upsert_index(spark, again, f"{ws.root}/old", f"{ws.root}/new").select("gse_id", "title", F.coalesce("organism", F.lit("")).alias("organism"))


@query(f"""with {_ST} select gse_id, case when s_suppkey % 3 = 0 then 'own text ' || s_suppkey else concat_ws(chr(10), title, summary) end as text from st""")
def fallback_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _studies(spark, sf_dir)
    return s.withColumn("document_text", F.when(F.col("s_suppkey") % 3 == 0, _text("own text ", F.col("s_suppkey"))).otherwise("")).select("gse_id", fallback_text().alias("text"))


@query(f"""with {_ST} select gse_id, 'metadata' as chunk_type, gse_id || ' metadata: ' || concat_ws(' | ', 'Tissues: ' || tissue, 'Diseases: ' || disease) as text from st where tissue is not null or disease is not null""")
def chunks_of_a_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_chunks(_studies(spark, sf_dir), ["metadata"]).select("gse_id", "chunk_type", "text")


_TEXT_QUERY = "supplies from the ASIA summary of"


@query(f"""with {_ST}, d as (select gse_id, title || ' ' || coalesce(summary, '') as t from st where organism = 'n0'), s as (select gse_id, {_overlap(_TEXT_QUERY, 't')} as n from d)
select gse_id, n::double as sparse_score, row_number() over (order by n desc, gse_id)::bigint as rank from s where n > 0 qualify rank <= 10""".replace("'n0'", "(select n_name from nation where n_nationkey = 3)"))
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = table(spark, sf_dir, "nation").where("n_nationkey = 3").first().n_name
    index = _studies(spark, sf_dir).drop("rank").withColumn("document_text", F.concat_ws(" ", "title", "summary"))
    out = search(index, _TEXT_QUERY, {"organism": name, "free_text": ""}, RetrievalSpec(strategy="sparse+filter", filter_scope="both"))
    return out.select("gse_id", F.col("sparse_score").cast("double").alias("sparse_score"), F.col("rank").cast("long").alias("rank"))


_FIRST, _SECOND = "the of and thing with", "la de que and to"


@query(f"""with a as (select doc_id, {_overlap(_FIRST)} as c, row_number() over (order by c desc, doc_id) as rank from documents where {_overlap(_FIRST)} > 0 qualify rank <= 10),
b as (select doc_id, {_overlap(_SECOND)} as c, row_number() over (order by c desc, doc_id) as rank from documents where {_overlap(_SECOND)} > 0 qualify rank <= 10),
f as (select doc_id, sum(1.0::double / (60 + rank)) as rrf, min(list * 1000 + rank) as tie from (select doc_id, rank, 0 as list from a union all select doc_id, rank, 1 from b) group by doc_id)
select doc_id, round(rrf, 12) as rrf, row_number() over (order by round(rrf, 12) desc, tie, doc_id)::bigint as rank from f qualify rank <= 10""")
def refined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document_text"), F.lit("t").alias("title"))
    out = multi_step(d, _FIRST, RetrievalSpec(strategy="sparse"), lambda q, titles: f" {_SECOND} " if len(titles) == 5 else "", key="doc_id")
    return out.select("doc_id", F.round("rrf", 12).alias("rrf"), F.col("rank").cast("long").alias("rank"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = top_k(_studies(spark, sf_dir).drop("rank").withColumn("at", -F.col("s_suppkey")), "at", "s_suppkey", 6)
    return s.withColumns({"dense_score": F.col("rank") / 8.0, "rerank_score": F.when(F.col("rank") % 2 == 0, F.col("rank") / 4.0).otherwise(0.0), "n_samples": F.col("donor_count")})


_RESULTS = f"{_ST}, r as (select *, s_suppkey + 1 as rank from st where s_suppkey < 6)"


@query(f"""with {_RESULTS}, b as (select rank, concat_ws(chr(10), '### ' || rank || '. ' || gse_id || ' — ' || title, '- **Organism**: ' || organism, '- **Tissues**: ' || tissue, '- **Diseases**: ' || disease,
case when donors > 0 then '- **Samples**: ' || donors end, '- **Relevance score**: ' || printf('%.3f', case when rank % 2 = 0 then rank / 4.0 else rank / 8.0 end), '') as t from r)
select '## Results for: "find them"' || chr(10) || chr(10) || 'Found **' || count(*) || ' datasets** matching your query.' || chr(10) || chr(10) || string_agg(t, chr(10) order by rank) as answer from b""")
def answer_from_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fallback_answer(_results(spark, sf_dir), "find them")


@query("select count(*) as total_results, 0.125::double as top_score, 0.0::double as top_rerank_score from supplier where s_suppkey < 6")
def answer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_stats(_results(spark, sf_dir))


@query("""select event_id, case when k = 2 then '' else sha1(t) end as raw_output_sha1, k = 1 as fallback_used, trim(t) = '' as empty_content, case when k = 3 then 'not_attempted' when k = 0 then 'ok' else 'no_json' end as parse_status,
case when k = 3 then 'timeout' else 'none' end as failure_class, round(event_id * 1234567 / 1000000.0, 1) as duration_ms from (select event_id, event_id % 4 as k, case event_id % 4 when 0 then '{"a": ' || event_id || '}' when 2 then '' else 'plain ' || event_type end as t from events)""")
def generation_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    text = F.when(k == 0, _text('{"a": ', F.col("event_id"), "}")).when(k == 2, "").otherwise(_text("plain ", F.col("event_type")))
    calls = e.select(text.alias("response"), (k == 1).alias("fallback_used"), F.col("event_id").cast("string").alias("model"), F.lit(1).alias("eval_tokens"), F.lit(2).alias("prompt_tokens"), (F.col("event_id") * 1234567).alias("duration_ns"), F.when(k == 3, "Read TIMEOUT after 3 s").alias("error"))
    return envelope(calls).select(F.col("model").cast("long").alias("event_id"), "raw_output_sha1", "fallback_used", "empty_content", "parse_status", "failure_class", "duration_ms")


# ---- organs, terms, models


@query(f"""with m as (select distinct case {' '.join(f"when {' or '.join(f'contains(t, {quoted(w)})' for w in ws)} then {quoted(o)}" for o, ws in lexicon.ORGANS)} else 'unknown' end as organ from (select lower(c_mktsegment || ' ' || case c_custkey % 3 when 0 then 'lung' when 1 then 'hepatic' else 'x' end) as t from customer)),
missing as (select organ from (values {', '.join(f'({quoted(o)})' for o, _ in lexicon.ORGANS)}) o(organ) where organ not in (select organ from m)),
c as (select o_orderkey, o_custkey, (list_value({', '.join(quoted(o) for o, _ in lexicon.ORGANS)}))[1 + o_custkey % {len(lexicon.ORGANS)}] as organ from orders where o_orderkey % 2 = 0 and o_orderkey % 3 = 0),
b as (select *, row_number() over (partition by organ order by o_orderkey) as n from c where organ in (select organ from missing) qualify n <= 5)
select organ, coalesce(string_agg('GSE' || o_orderkey || ':1', ',' order by n) filter (n is not null), '') as candidates from missing left join b using (organ) group by organ""")
def organ_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("o_orderkey")
    manifests = c.select(F.col("c_mktsegment").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "Lung").when(F.col("c_custkey") % 3 == 1, "hepatic").otherwise("x").alias("summary"), F.lit("").alias("overall_design"))
    organs = F.array(*(F.lit(x) for x, _ in lexicon.ORGANS))
    sid = _text("GSE", k).alias("series_id")
    candidates = o.select(
        F.element_at(organs, (F.col("o_custkey") % len(lexicon.ORGANS) + 1).cast("int")).alias("organ"),
        k.alias("pos"),
        sid,
        F.lit("t").alias("title"),
        F.lit("human").alias("organism"),
        F.when(k % 2 == 0, "cancer").otherwise("").alias("domain"),
        F.array(F.lit("rna")).alias("modalities"),
        F.lit("h5ad").alias("available_formats"),
    )
    from quarry.operators.rules import classify_files

    found = classify_files(o.select(sid, k.alias("pos"), F.when(k % 3 == 0, _text("f", k, "_gex.h5ad")).otherwise(_text("f", k, ".pdf")).alias("url")))
    out = organ_gaps(manifests, candidates, found, ["h5ad"])
    return out.select("organ", F.coalesce(F.array_join(F.transform("candidates", lambda x: F.concat(x["series_id"], F.lit(":"), x["n_matched_files"].cast("string"))), ","), F.lit("")).alias("candidates"))


@query("""select 'GSE' || c_custkey as gse_id, 'tissue' as category, c_mktsegment || '=' || 'T:' || length(c_mktsegment) || '; none' as mapped from customer where c_custkey % 2 = 0 union all select 'GSE' || c_custkey, 'disease', 'x=' from customer""")
def study_term_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, empty = table(spark, sf_dir, "customer"), F.array().cast(_STRINGS)
    studies = c.select(_text("GSE", F.col("c_custkey")).alias("gse_id"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit("none"))).otherwise(empty).alias("tissues"), F.array(F.lit("x")).alias("diseases"), empty.alias("cell_types"))
    matched = c.select(F.lit("tissue").alias("category"), F.col("c_mktsegment").alias("raw"), F.lit("UBERON").alias("onto"), _text("T:", F.length("c_mktsegment")).alias("id"), F.col("c_mktsegment").alias("onto_name"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method")).distinct()
    out = study_mappings(studies, matched)
    shown = F.transform("mappings", lambda m: F.when(m["id"].isNotNull(), F.concat(m["raw"], F.lit("="), m["id"])).when(m["raw"] == "x", "x=").otherwise(m["raw"]))
    return out.select("gse_id", "category", F.array_join(shown, "; ").alias("mapped"))


@query("""with m as (select p_partkey, p_partkey % 3 as wave, p_brand as family, p_size::double as size_b, p_partkey % 4 = 0 as pulled from part)
select 'k' || p_partkey as key, family, coalesce(case when p_partkey % 5 != 0 then size_b * 2 end, 5.0) as download_gb from m where not pulled and wave = 1 and family = 'Brand#17'""")
def open_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("double")
    models = p.select(_text("k", k).alias("key"), _text("m/", k).alias("full_name"), F.col("p_brand").alias("family"), (k % 3).cast("int").alias("wave"), size.alias("size_b"), F.when(k % 5 != 0, size * 2).alias("vram_gb"), F.lit(True).alias("enabled"), F.lit(False).alias("cpu_spill"))
    pulled = p.where(k % 4 == 0).select(_text("m/", k, ":latest").alias("name"))
    return filter_plan(build_plan(models, pulled), missing_only=True, wave=1, family="Brand#17").select("key", "family", "download_gb")


@query("""select name, case when n % 3 = 2 then null else 'k' || n end as key, case when n % 3 = 2 then 'unknown' else p_brand end as family, case when n % 3 != 2 and p_brand = 'Brand#1' then 'json' else '' end as json_hint
from (select p_partkey as n, p_brand, case p_partkey % 3 when 0 then 'k' || p_partkey when 1 then 'm/' || p_partkey || ':latest' else 'no' || p_partkey end as name from part)""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    wanted = p.select(F.when(k % 3 == 0, _text("k", k)).when(k % 3 == 1, _text("m/", k, ":latest")).otherwise(_text("no", k)).alias("name"))
    registry = p.select(_text("k", k).alias("key"), _text("m/", k).alias("full_name"), F.col("p_brand").alias("family"), k.alias("pos"))
    registry = registry.union(registry.select(F.concat("key", F.lit("b")), "full_name", "family", F.col("pos") + 100_000_000))
    families = spark.createDataFrame([("Brand#1", "json")], "family string, json_hint string")
    return resolve_names(wanted, registry, families).select("name", "key", "family", "json_hint")


# ---- evaluation: every second item is answered rightly


def _items(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Items of all kinds of tasks, or of the first ``most``, from events: (evaluator, answer_field, shift, item_id, item, response)."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    right = (F.expr("event_id div 14") % 2 == 0)
    letter = F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1))
    wrong = F.substring(F.lit("BCDA"), (k % 4 + 1).cast("int"), F.lit(1))
    kinds = [
        ("mcq_letter", _text('{"answer": "', F.lower(letter), '"}'), F.when(right, letter).otherwise(wrong)),
        ("mcq_index", _text('{"answer": ', k % 4, "}"), F.when(right, _text("The answer is ", letter)).otherwise(_text(wrong, ". so"))),
        ("mcq_index_str", _text('{"answer": "', k % 4 + 1, '"}'), F.when(right, letter).otherwise(wrong)),
        ("binary_choice", _text('{"answer": "', k % 2 + 1, '"}'), F.when(right, _text("It is ", k % 2 + 1)).otherwise(_text("It is ", (k + 1) % 2 + 1))),
        ("boolean", _text('{"answer": "', F.when(k % 2 == 0, "true").otherwise("false"), '"}'), F.when(right == (k % 2 == 0), "well yes indeed").otherwise("no, not yes")),
        ("gsm8k", _text('{"answer": "so #### 1,', F.lpad((k % 1000).cast("string"), 3, "0"), '"}'), F.when(right, _text("3 and 1", F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise("#### 7")),
        ("truthfulqa", F.lit('{"mc1_targets": {"choices": ["a", "b"], "labels": [0, 1]}}'), F.when(right, "B").otherwise("A")),
        ("pubmedqa", F.lit('{"answer": "maybe"}'), F.when(right, "Perhaps it is so").otherwise("Yes, it is")),
        ("token_f1", F.lit('{"answer": "red fox"}'), F.when(right, "Red FOX").otherwise("red wolf")),
        ("ifeval", F.lit('{"instruction_id_list": ["punctuation:no_comma", "x:y"]}'), F.when(right, "no such mark").otherwise("one, two")),
        ("json_schema", F.lit('{"answer": ""}'), F.when(right, '```json\n{"a": 1}\n```').otherwise("{broken")),
        ("nexus_fc", F.lit('{"python_function_name": "get_it"}'), F.when(right, "Call: GET_IT(3)").otherwise("other(3)")),
        ("glaive_fc", F.lit("{}"), F.when(right, "<functioncall> {}").otherwise("I cannot")),
        ("toolace", F.lit("{}"), F.when(right, "do(x)").otherwise("nothing")),
        ("sciq", F.lit('{"distractor1": "red", "distractor2": "green", "distractor3": "blue", "correct_answer": "right"}'), F.when(right, "A").otherwise("none of them")),
    ]
    kinds = kinds[:most]
    rows = F.array(*(F.struct(F.lit(n).alias("evaluator"), i.alias("item"), r.alias("response")) for n, i, r in kinds))
    one = e.select("event_id", F.element_at(rows, (k % len(kinds) + 1).cast("int")).alias("x")).select("event_id", "x.*")
    return one.select("event_id", "evaluator", F.lit("answer").alias("answer_field"), F.lit(-1).alias("shift"), F.col("event_id").cast("string").alias("item_id"), "item", "response")


_KINDS = ("mcq_letter", "mcq_index", "mcq_index_str", "binary_choice", "boolean", "gsm8k", "truthfulqa", "pubmedqa", "token_f1", "ifeval", "json_schema", "nexus_fc", "glaive_fc", "toolace", "sciq")
def _scored(kinds: tuple[str, ...]) -> str:
    return f"""i as (select event_id, ([{', '.join(quoted(x) for x in kinds)}])[1 + event_id % {len(kinds)}] as evaluator, (event_id // 14) % 2 = 0 as good from events),
s as (select event_id, evaluator, case when evaluator = 'token_f1' then 0 when evaluator = 'boolean' then case when event_id % 2 = 0 then 1 else 0 end when evaluator in ('nexus_fc') then 1
  when evaluator = 'sciq' then case when good and list_sort(list_transform(['red', 'green', 'blue', 'right'], lambda c: md5(c || '|' || event_id) || c))[1][33:] = 'right' then 1 else 0 end when good then 1 else 0 end as correct,
case evaluator when 'token_f1' then case when good then 1.0 else 0.5 end when 'ifeval' then case when good then 1.0 else 0.5 end when 'nexus_fc' then case when good then 1.0 else 0.0 end when 'glaive_fc' then case when good then 1.0 else 0.0 end when 'toolace' then case when good then 1.0 else 0.0 end end as score from i)"""


@query(f"with {_scored(_KINDS)} select event_id, evaluator, correct::bigint as correct, score::double as score from s")
def evaluator_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_items(_items(spark, sf_dir)).where("counted").select("event_id", "evaluator", F.col("correct").cast("long").alias("correct"), F.col("score").cast("double").alias("score"))


@query(f"""with {_scored(_KINDS[:14])}, d as (select event_id % 3 as model, case when length(evaluator) % 2 = 0 then 'even' else 'odd' end as category, evaluator, round(avg(correct), 4) as accuracy from s group by all),
c as (select model, category, round(avg(accuracy), 4) as composite from d group by all) select 'm' || model as model, max(composite) filter (category = 'even') as even, max(composite) filter (category = 'odd') as odd from c group by model""")
def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = score_items(_items(spark, sf_dir, 14)).withColumns({"model": _text("m", F.col("event_id") % 3), "category": F.when(F.length("evaluator") % 2 == 0, "even").otherwise("odd")})
    out = run_records(category_composites(dataset_results(x, ["model", "category", "evaluator"]), ["model", "category"]))
    return out.select("model", *(F.try_element_at("composites", F.lit(c)).alias(c) for c in ("even", "odd")))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'Question: what is ' || p_name || chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || p_brand || chr(10) || chr(10) || 'Answer with ONLY the letter (A, B, C, or D).'
when 1 then p_name || chr(10) || chr(10) || '1. ' || p_type || chr(10) || '2. ' || p_brand || chr(10) || chr(10) || 'Reply with 1 or 2 only.'
when 2 then 'Passage: ' || left(repeat(p_name || ' ', 60), 500) || chr(10) || chr(10) || 'Question: so?' || chr(10) || chr(10) || 'Reply with yes or no only.' else 'call for ' || p_name end as prompt from part""")
def task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    item = (
        F.when(k == 0, _text('{"question": "what is ', F.col("p_name"), '", "choices": ["', F.col("p_type"), '", "', F.col("p_brand"), '"]}'))
        .when(k == 1, _text('{"sentence": "', F.col("p_name"), '", "option1": "', F.col("p_type"), '", "option2": "', F.col("p_brand"), '"}'))
        .when(k == 2, _text('{"question": "so?", "passage": "', F.repeat(F.concat("p_name", F.lit(" ")), F.lit(60)), '"}'))
        .otherwise(_text('{"prompt": "call for ', F.col("p_name"), '"}'))
    )
    kind = F.when(k == 0, "mcq_index").when(k == 1, "binary_choice").when(k == 2, "boolean").otherwise("nexus_fc")
    out = prompts(p.select("p_partkey", F.col("p_partkey").cast("string").alias("item_id"), kind.alias("evaluator"), item.alias("item")))
    return out.select("p_partkey", "prompt")


@query("select case when p_partkey % 2 = 0 then 'even' else 'odd' end as dataset, p_name as title, count(*) as items from part group by all")
def registered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "registry")
    p = table(spark, sf_dir, "part")
    for i, name in enumerate(("even", "odd", "unregistered")):
        p.where(F.col("p_partkey") % 2 == i % 2).select(_text('{"title": "', F.col("p_name"), '"}').alias("value")).write.text(f"{ws.root}/sets/{name}")
    registry = spark.createDataFrame([("even", "gsm8k"), ("odd", "boolean"), ("absent", "boolean")], "dataset string, evaluator string")
    return read_items(spark, registry, f"{ws.root}/sets").groupBy("dataset", F.get_json_object("item", "$.title").alias("title")).agg(F.count("*").alias("items"))


@query("""select distinct failure, coalesce(try_cast(regexp_extract(failure, '(\\d+)', 1) as bigint), -1) as number, case when contains(lower(failure), 'timeout') then 'timeout' when contains(lower(failure), 'oom') then 'oom' else 'error' end as class
from (select case event_id % 3 when 0 then 'Timeout after ' || event_id % 50 when 1 then 'CUDA OOM' else 'broken ' || event_type end as failure from events)""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    text = F.when(k % 3 == 0, _text("Timeout after ", k % 50)).when(k % 3 == 1, "CUDA OOM").otherwise(_text("broken ", F.col("event_type")))
    return e.select(text.alias("failure")).distinct().select("failure", F.coalesce(first_number(F.col("failure")).cast("long"), F.lit(-1)).alias("number"), failure_class(F.col("failure")).alias("class"))
