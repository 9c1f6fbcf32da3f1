"""Landed XML, HTML and JSON: search summaries, articles, listings, accession indexes and studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import extract
from quarry.operators.ranking import first_wins
from quarry.operators.rules import listing_folder

ARTICLE = "MedlineCitation struct<PMID: struct<_VALUE: string>, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>>, MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string>>>>, KeywordList: array<struct<Keyword: array<struct<_VALUE: string>>>>>"
SUMMARY = "Id string, Item array<struct<_Name: string, _Type: string, _VALUE: string, Item: array<struct<_Name: string, _Type: string, _VALUE: string>>>>"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract, mesh_terms, keywords); labelled abstract parts joined by a space."""
    return articles_of(spark.read.format("xml").option("rowTag", "PubmedArticle").option("attributePrefix", "_").schema(ARTICLE).load(path))


def articles_of(rows: DataFrame) -> DataFrame:
    """Articles of rows of the schema ARTICLE."""
    c = F.col("MedlineCitation")
    parts = F.transform(c["Article"]["Abstract"]["AbstractText"], lambda p: F.concat(F.when(F.coalesce(p["_Label"], F.lit("")) != "", F.concat(p["_Label"], F.lit(": "))).otherwise(""), F.coalesce(p["_VALUE"], F.lit(""))))
    some = lambda x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return rows.select(
        F.coalesce(c["PMID"]["_VALUE"], F.lit("")).alias("pmid"),
        F.coalesce(c["Article"]["ArticleTitle"], F.lit("")).alias("title"),
        F.coalesce(F.array_join(parts, " "), F.lit("")).alias("abstract"),
        some(F.transform(c["MeshHeadingList"]["MeshHeading"], lambda m: m["DescriptorName"]["_VALUE"])).alias("mesh_terms"),
        some(F.flatten(F.transform(c["KeywordList"], lambda k: F.transform(k["Keyword"], lambda w: w["_VALUE"])))).alias("keywords"),
    )


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(uid, strings map, integers map, lists map) of search summaries, by the type of each item."""
    rows = spark.read.format("xml").option("rowTag", "DocSum").option("attributePrefix", "_").schema(SUMMARY).load(path)
    return summaries_of(rows.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("_file")))


def summaries_of(rows: DataFrame) -> DataFrame:
    """Summaries of rows of the schema SUMMARY; other columns stay."""

    def of(kind: str, value) -> Column:
        items = F.filter("Item", lambda i: i["_Type"] == kind)
        names = F.array_distinct(F.transform(items, lambda i: i["_Name"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: value(F.try_element_at(F.filter(items, lambda i: i["_Name"] == n), F.lit(-1)))))

    text = of("String", lambda i: F.coalesce(i["_VALUE"], F.lit("")))
    number = of("Integer", lambda i: F.coalesce(i["_VALUE"].try_cast("int"), F.lit(0)))
    many = of("List", lambda i: F.filter(F.transform(F.coalesce(i["Item"], F.array().cast(rows.schema["Item"].dataType.elementType["Item"].dataType)), lambda x: x["_VALUE"]), lambda v: v.isNotNull()))
    return rows.select(F.col("Id").alias("uid"), text.alias("strings"), number.alias("integers"), many.alias("lists"), *(c for c in rows.columns if c not in ("Id", "Item")))


def parsed_documents(documents: DataFrame, schema: str) -> DataFrame:
    """Documents (id, at, document, error) of the archive as rows of a schema, with their place; those with errors leave."""
    x = documents.where("error = ''").select("at", F.from_xml("document", schema, {"attributePrefix": "_"}).alias("d"))
    return x.select("d.*", F.col("at").alias("_at"))


def series_of_summary(accession: Column, entry_type: Column, uid: Column, record: Column) -> Column:
    """Series accession of a search hit: its own, else by entry type, else the first in the record, else by a 200 uid."""
    return F.coalesce(
        F.when(accession.startswith("GSE"), accession),
        F.when(entry_type == "GSE", F.concat(F.lit("GSE"), uid)),
        extract(record, r"(GSE\d+)"),
        F.when(uid.startswith("200"), F.concat(F.lit("GSE"), F.substring(uid, F.lit(4), F.length(uid)))),
    )


def series_hits(summaries: DataFrame) -> DataFrame:
    """One row per series, the first hit wins; hits without a series leave.

    The first is the newest by place (``_at``) where the archive gave one, else the first by file, place in the file and uid.
    """
    s, n, lists = F.col("strings"), F.col("integers"), F.col("lists")
    text = lambda k: F.coalesce(F.try_element_at(s, F.lit(k)), F.lit(""))
    place = [(-F.col("_at")).alias("at")] if "_at" in summaries.columns else [F.col("_file")] if "_file" in summaries.columns else []
    x = summaries.withColumn("pos", F.struct(*place, F.monotonically_increasing_id().alias("n")))
    x = x.withColumn("series_id", series_of_summary(text("Accession"), text("entryType"), F.col("uid"), F.to_json(F.struct("uid", "strings"))))
    x = first_wins(x.where("series_id is not null"), ["series_id"], ["pos"])
    return x.select(
        "series_id",
        text("title").alias("title"),
        text("summary").alias("summary"),
        text("taxon").alias("organism"),
        text("GPL").alias("platform"),
        F.coalesce(F.try_element_at(n, F.lit("n_samples")), F.lit(0)).alias("n_samples"),
        text("gdsType").alias("series_type"),
        text("PDAT").alias("submission_date"),
        F.coalesce(F.try_element_at(lists, F.lit("PubMedIds")), F.array().cast("array<string>")).alias("pubmed_ids"),
        listing_folder(F.col("series_id")).alias("ftp_link"),
        "pos",
    )


def links(html: Column) -> Column:
    """Targets of anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def listed_files(listings: DataFrame, series: str = "series_id", html: str = "html") -> DataFrame:
    """(series_id, pos, url) of relative anchors in a folder listing; parents, queries and other sites are left out."""
    keep = F.filter(links(F.col(html)), lambda h: (h != "") & ~h.startswith("/") & ~h.startswith("?") & ~h.startswith("http"))
    return listings.select(series, F.posexplode(keep).alias("pos", "name")).select(series, "pos", F.concat(listing_folder(F.col(series)), F.lit("suppl/"), "name").alias("url"))


_OBJECT = "map<string, variant>"


def accession_index(texts: DataFrame, text: str = "value") -> DataFrame:
    """Distinct accessions of JSON indexes: keys of gse_folder_index, else keys like one at the first two levels.

    Each text is parsed once; texts that are no JSON objects have none.
    """
    top = F.try_variant_get(F.try_parse_json(text), "$", _OBJECT)
    found = texts.select(top.alias("top")).where("top is not null")
    keys = lambda v: F.map_keys(F.try_variant_get(v, "$", _OBJECT))
    deep = F.flatten(F.transform(F.map_values("top"), lambda v: F.coalesce(keys(v), F.array().cast("array<string>"))))
    named = F.try_element_at("top", F.lit("gse_folder_index"))
    some = F.when(named.isNotNull(), keys(named)).otherwise(F.filter(F.concat(F.map_keys("top"), deep), lambda k: k.startswith("GSE")))
    return found.select(F.explode(some).alias("series_id")).distinct()


_SUMMARY = "struct<tissues: array<string>, diseases: array<string>, cell_types: array<string>, treatments: array<string>, organisms: array<string>, donor_count: int, sex: array<string>, age_range: string>"
_PUBMED = "struct<pmid: string, title: string, abstract: string, mesh_terms: array<string>, keywords: array<string>>"
#: Fields of a study's document that columns are made of. ``pubmed`` is an article or a list of them.
FIELDS = {
    **dict.fromkeys(("gse_id", "title", "summary", "overall_design", "organism", "platform", "series_type"), "string"),
    **dict.fromkeys(("n_samples", "sample_count"), "int"),
    **dict.fromkeys(("submission_date", "domain", "document_text"), "string"),
    **dict.fromkeys(("modalities", "tissues", "diseases", "cell_types", "treatments"), "array<string>"),
    "characteristics_summary": _SUMMARY,
    "pubmed": "variant",
}
STUDY = ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def study_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc) of the studies in JSON files, as variants: one to a line, or a file that is one document or an array of them.

    Files are read as lines, which Spark splits; a file with a line that is no JSON by itself is read again as a whole, and
    skipped if that is no JSON either.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) != ''")
    parsed = lines.select("file", F.try_parse_json("value").alias("v"))
    whole_files = parsed.where("v is null").select("file").distinct()
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").join(whole_files, "file", "left_semi")
    some = parsed.join(whole_files, "file", "left_anti").select("v").unionByName(whole.select(F.try_parse_json("value").alias("v")))
    many = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return some.where("v is not null").select(F.explode(many).alias("doc")).where(F.try_variant_get("doc", "$", _OBJECT).isNotNull())


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Studies from JSON files in either shape: nested or flat terms, one article or a list; bad files are skipped."""
    return studies_of(study_documents(spark, path))


def studies_of(documents: DataFrame) -> DataFrame:
    """Columns of studies' documents (doc); a field of another type than its column's is null."""
    return shape_studies(documents.select(*(F.try_variant_get("doc", f"$.{n}", t).alias(n) for n, t in FIELDS.items())))


def shape_studies(raw: DataFrame) -> DataFrame:
    """Flat study columns with defaults in place of nulls."""
    empty = F.array().cast("array<string>")
    c = F.col("characteristics_summary")
    terms = {t: F.coalesce(F.when(F.size(F.col(t)) > 0, F.col(t)), c[t], empty) for t in ("tissues", "diseases", "cell_types", "treatments")}
    text = {t: F.coalesce(t, F.lit("")) for t in ("title", "summary", "overall_design", "organism", "platform", "series_type", "submission_date", "domain")}
    article = F.coalesce(F.try_variant_get("pubmed", "$[0]", _PUBMED), F.try_variant_get("pubmed", "$", _PUBMED))
    return raw.select(
        F.coalesce("gse_id", F.lit("")).alias("gse_id"),
        *(v.alias(k) for k, v in text.items()),
        F.coalesce("n_samples", "sample_count", F.lit(0)).alias("n_samples"),
        F.coalesce("modalities", empty).alias("modalities"),
        *(v.alias(k) for k, v in terms.items()),
        F.coalesce(c["donor_count"], F.lit(0)).alias("donor_count"),
        article.alias("pubmed"),
        F.coalesce("document_text", F.lit("")).alias("document_text"),
    )


def with_mappings(documents: DataFrame, mappings: DataFrame) -> DataFrame:
    """Documents (doc) with ``ontology_mappings`` from (gse_id, category, mappings); all other fields stay as they are.

    Former mappings of a study that has none now go.
    """
    m = F.transform("mappings", lambda x: F.struct(x["raw"].alias("raw_term"), x["id"].alias("ontology_id"), x["onto_name"].alias("ontology_name"), x["onto"].alias("ontology"), x["confidence"].alias("confidence"), x["method"].alias("method")))
    of = mappings.groupBy("gse_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", m.alias("m"))))).alias("_m"))
    x = documents.withColumn("gse_id", F.try_variant_get("doc", "$.gse_id", "string")).join(of, "gse_id", "left")
    fields = F.map_filter(F.try_variant_get("doc", "$", _OBJECT), lambda k, _: k != "ontology_mappings")
    added = F.when(F.col("_m").isNull(), fields).otherwise(F.map_concat(fields, F.create_map(F.lit("ontology_mappings"), F.to_variant_object("_m"))))
    return x.select(F.parse_json(F.to_json(added)).alias("doc"))


def study_by_id(studies: DataFrame, gse_id: str) -> DataFrame:
    return studies.where(F.col("gse_id") == gse_id).limit(1)


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """(count, ids, web_env, query_key) of landed search answers; what is missing is 0, empty or ''."""
    schema = "Count string, IdList struct<Id: array<string>>, WebEnv string, QueryKey string"
    rows = spark.read.format("xml").option("rowTag", "eSearchResult").schema(schema).load(path)
    text = lambda c: F.coalesce(c, F.lit(""))
    ids = F.filter(F.coalesce(F.col("IdList.Id"), F.array().cast("array<string>")), lambda i: text(i) != "")
    return rows.select(F.coalesce(F.col("Count").try_cast("long"), F.lit(0)).alias("count"), ids.alias("ids"), text(F.col("WebEnv")).alias("web_env"), text(F.col("QueryKey")).alias("query_key"))
