"""File, dataset and text rules. Orders are files of series, documents are study texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexicon
from quarry.functions.text import failure_class, format_bytes, sample_id, series_ids
from quarry.operators.datasets import apply_filters, best_output, dataset_flags, download_order, downloadable, filter_files, matrix_triplets, modalities_text, not_elsewhere
from quarry.operators.ranking import first_wins
from quarry.operators.rules import canonical_name, classify_files, converter_format, domain_first, domain_score, listing_folder, looks_single_cell, modalities_in_order, modalities_of_text, name_modality, organ_first, organism_name, parse_query
from quarry.queries.base import CLASSIFIED_SQL, FILES_SQL, any_sql, files, query, quoted, words_sql
from quarry.tables import table


@query(f"with {CLASSIFIED_SQL} select pos, file_name, format_type, modality_signal, processing_level, matrix_type, is_count_matrix from classified")
def classify_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_files(files(spark, sf_dir)).select("pos", "file_name", "format_type", "modality_signal", "processing_level", "matrix_type", "is_count_matrix")


_STRONG = ", ".join(quoted(x) for x in lexicon.CONVERTIBLE if x not in ("csv", "tsv"))
FLAGS_SQL = f"""{CLASSIFIED_SQL}, flags as (select series_id, count(*) as n_files,
  bool_or(format_type = 'h5_10x_filtered_feature' or (format_type = 'h5_generic' and matrix_type = 'filtered_feature_bc_matrix')) as has_h5_10x_filtered_feature,
  bool_or(format_type = 'h5_10x_raw_feature') as has_h5_10x_raw_feature,
  bool_or(format_type = 'h5_10x_filtered_peak' or (format_type = 'h5_generic' and matrix_type = 'filtered_peak_bc_matrix')) as has_h5_10x_filtered_peak,
  bool_or(format_type = 'h5_10x_raw_peak') as has_h5_10x_raw_peak, bool_or(format_type = 'h5ad') as has_h5ad,
  bool_or(format_type = 'mtx_matrix') and count(distinct case when format_type like 'mtx%' then format_type end) >= 2 as has_mtx_triplet,
  bool_or(format_type = 'loom') as has_loom, bool_or(format_type in ('csv', 'tsv')) as has_csv_tsv, bool_or(format_type = 'fragments') as has_fragments,
  bool_or(format_type = 'tar') as has_tar, bool_or(format_type = 'rds') as has_rds,
  list_distinct(list(modality_signal) filter (modality_signal != 'unknown')) as seen,
  bool_or(format_type in ({_STRONG}) or (format_type in ('csv', 'tsv') and is_count_matrix)) as is_convertible from classified group by series_id),
known as (select *, case when len(coalesce(seen, [])) > 0 then seen else list_filter([case when has_h5_10x_filtered_feature or has_h5_10x_raw_feature then 'rna' end,
  case when has_h5_10x_filtered_peak or has_h5_10x_raw_peak or has_fragments then 'atac' end], lambda x: x is not null) end as k from flags),
datasets as (select *, list_sort(list_distinct(case when list_contains(k, 'rna') and list_contains(k, 'atac') then list_append(k, 'multiome') else k end)) as modalities,
  coalesce(nullif(array_to_string(list_filter([{', '.join(f"case when {c} then {quoted(n)} end" for c, n in lexicon.FORMAT_NAMES)}], lambda x: x is not null), ', '), ''), 'none') as available_formats from known)"""


@query(f"""with {FLAGS_SQL} select series_id, n_files, {', '.join(c for c, _ in lexicon.FORMAT_NAMES)}, is_convertible, available_formats,
coalesce(nullif(array_to_string(modalities, ', '), ''), 'unknown') as modalities from datasets""")
def dataset_flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset_flags(classify_files(files(spark, sf_dir)))
    return out.select("series_id", "n_files", *(c for c, _ in lexicon.FORMAT_NAMES), "is_convertible", "available_formats", modalities_text(F.col("modalities")).alias("modalities"))


@query(f"with {CLASSIFIED_SQL} select pos, format_type from classified where format_type in ('mtx_matrix', 'mtx_barcodes', 'mtx_features') or is_count_matrix")
def file_filter_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_files(classify_files(files(spark, sf_dir)), ["MTX ", "count_matrix", "nothing"]).select("pos", "format_type")


@query(f"with {CLASSIFIED_SQL} select pos, modality_signal from classified where modality_signal in ('atac', 'unknown')")
def file_filter_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_files(classify_files(files(spark, sf_dir)), modality="atac").select("pos", "modality_signal")


@query(f"with {CLASSIFIED_SQL} select pos from classified where is_count_matrix or format_type != 'rds'")
def downloadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downloadable(classify_files(files(spark, sf_dir))).select("pos")


@query(f"with {FLAGS_SQL} select series_id from datasets where is_convertible")
def convertible_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_flags(classify_files(files(spark, sf_dir))).where("is_convertible").select("series_id")


_SERIES_SQL = f"""{FLAGS_SQL}, owners as (select 'GSE' || c_custkey as series_id, case c_nationkey % 3 when 0 then 'Homo sapiens' when 1 then 'Mus musculus' else 'Danio rerio' end as organism,
  case c_mktsegment when 'BUILDING' then 'cancer' when 'MACHINERY' then 'development' else 'normal' end as domain from customer)"""


@query(f"""with {_SERIES_SQL}, good as (select series_id from datasets join owners using (series_id) where is_convertible and domain = 'normal' and (list_contains(modalities, 'multiome') or (list_contains(modalities, 'rna') and list_contains(modalities, 'atac')))
and contains(lower(organism), 'homo sapiens')), kept as (select series_id, count(*) as matching_files from classified where format_type in ('h5_10x_filtered_feature', 'h5ad') group by series_id)
select series_id, matching_files from good join kept using (series_id)""")
def apply_filters_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify_files(files(spark, sf_dir))
    names = F.element_at(F.array(*(F.lit(x) for x in ("Homo sapiens", "Mus musculus", "Danio rerio"))), F.col("c_nationkey") % 3 + 1)
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "cancer").when(F.col("c_mktsegment") == "MACHINERY", "development").otherwise("normal")
    owners = table(spark, sf_dir, "customer").select(F.concat(F.lit("GSE"), "c_custkey").alias("series_id"), names.alias("organism"), kind.alias("domain"))
    series, kept = apply_filters(dataset_flags(c).join(owners, "series_id"), c, domain="Normal", modality="multiome", formats=["filtered_feature_h5", "h5ad"], organism="human", require_format=True, require_convertible=True)
    return kept.groupBy("series_id").agg(F.count("*").alias("matching_files")).join(series.select("series_id"), "series_id", "left_semi")


_BUCKET = """case when regexp_matches(n, '\\.h5ad(\\.gz)?$') then 'h5ad' when regexp_matches(n, '\\.h5(\\.gz)?$') then 'h5'
 when contains(n, 'matrix.mtx') or contains(n, 'barcodes.tsv') or contains(n, 'features.tsv') or contains(n, 'genes.tsv') then 'mtx'
 when regexp_matches(n, '\\.(csv|tsv|txt)(\\.gz)?$') then 'csv_tsv' when regexp_matches(n, '\\.loom(\\.gz)?$') then 'loom' when regexp_matches(n, '\\.(tar|tar\\.gz|tgz)$') then 'tar' else 'other' end"""


@query(f"""with {FILES_SQL}, b as (select *, {_BUCKET} as bucket from (select *, lower(url) as n from files)),
k as (select *, bool_or(bucket != 'other') over (partition by series_id) as known from b),
s as (select *, list_position(['h5ad', 'h5', 'mtx', 'tar', 'csv_tsv', 'loom', 'other'], bucket) as prio from k where (bucket != 'other' or not known) and size_bytes <= 5.0 * 1024 * 1024 * 1024)
select series_id, pos, bucket, row_number() over (partition by series_id order by prio, pos)::bigint as rank from s""")
def download_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return download_order(files(spark, sf_dir), size="size_bytes").select("series_id", "pos", "bucket", F.col("rank").cast("long").alias("rank"))


_NAME_MOD = """case when contains(n, 'peak_bc_matrix') or contains(n, 'atac') or contains(n, 'fragments') then 'atac' when contains(n, 'feature_bc_matrix') or contains(n, 'rna') or contains(n, 'gene') then 'rna'
 when contains(n, 'multiome') or contains(n, 'arc') then 'multiome' else 'unknown' end"""


@query(f"""with {FILES_SQL} select pos, series_id || '__' || upper(regexp_extract(url, '(?i)(GSM\\d+)', 1)) || '__' || {_NAME_MOD} || '__' ||
regexp_replace(regexp_replace(url, '\\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g') || regexp_extract(url, '(\\.[^.]*)$', 1) as canonical_name, {_NAME_MOD} as modality, upper(regexp_extract(url, '(?i)(GSM\\d+)', 1)) as gsm_id
from (select *, lower(url) as n from files)""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return f.select("pos", canonical_name(F.col("series_id"), F.col("url")).alias("canonical_name"), name_modality(F.col("url")).alias("modality"), sample_id(F.col("url")).alias("gsm_id"))


@query(f"""with {FILES_SQL} select pos, case when ends_with(n, '.h5ad') then 'h5ad' when ends_with(n, '.h5ad.gz') then 'h5ad_gz' when ends_with(n, '.h5') then 'h5_other' when contains(n, 'matrix.mtx') then 'mtx' when ends_with(n, '.loom') then 'loom'
when regexp_matches(n, '\\.(tar\\.gz|tgz|tar)$') then 'tar' when regexp_matches(n, '\\.csv(\\.gz)?$') then 'csv' when regexp_matches(n, '\\.(tsv|txt)(\\.gz)?$') then 'tsv' when ends_with(n, '.gz') then 'gz' else 'unknown' end as format
from (select *, lower(url) as n from files)""")
def converter_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("pos", converter_format(F.col("url")).alias("format"))


@query(f"""with {FILES_SQL}, j as (select series_id, lower(string_agg(url, ' ' order by pos)) as names from files group by series_id) select series_id, {any_sql('names', lexicon.SINGLE_CELL)} as is_single_cell from j""")
def single_cell_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = files(spark, sf_dir).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("names"))
    return g.select("series_id", looks_single_cell(F.col("names")).alias("is_single_cell"))


@query(f"""with {FILES_SQL}, p as (select series_id, pos, case pos % 3 when 0 then lower(series_id) || '.h5ad' when 1 then series_id || '_MERGED.h5ad' else series_id || '_' || pos || '.h5ad' end as base from files)
select series_id, arg_min('/out/' || base, [case when lower(base) = lower(series_id) || '.h5ad' then 0 when lower(base) = lower(series_id) || '_merged.h5ad' then 1 else 2 end, pos]) as path from p group by series_id""")
def best_file_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("series_id")
    base = F.when(F.col("pos") % 3 == 0, F.concat(F.lower(s), F.lit(".h5ad"))).when(F.col("pos") % 3 == 1, F.concat(s, F.lit("_MERGED.h5ad"))).otherwise(F.concat(s, F.lit("_"), "pos", F.lit(".h5ad")))
    return best_output(files(spark, sf_dir).select("pos", F.concat(F.lit("/out/"), base).alias("path")))


_LABELS = list(lexicon.DOMAIN_PATTERNS)
_FIXED = ", ".join(f"list_filter([{', '.join('case when regexp_matches(t, ' + quoted('(?i)' + p) + ') then ' + quoted(p) + ' end' for p in lexicon.DOMAIN_PATTERNS[d])}], lambda x: x is not null) as {d}" for d in _LABELS)


@query(f"""with f as (select doc_id, {_FIXED} from (select doc_id, lower(text) as t from documents)),
n as (select *, greatest({', '.join(f'len({d})' for d in _LABELS)}) as most from f),
l as (select *, case when most = 0 then 'unknown' when len(cancer) >= 2 then 'cancer' when len(cancer) = 1 and len(development) > 2 then 'development' {' '.join(f"when len({d}) = most then '{d}'" for d in _LABELS)} end as domain from n)
select doc_id, domain, case domain {' '.join(f"when '{d}' then array_to_string({d}, '|')" for d in _LABELS)} else '' end as keywords from l""")
def domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", domain_score(F.col("text")).alias("d"))
    return d.select("doc_id", "d.domain", F.array_join("d.keywords", "|").alias("keywords"))


@query(f"select doc_id, {words_sql('lower(text)', lexicon.DOMAIN_WORDS, '')} as domain, {words_sql('lower(text)', lexicon.ORGANS, 'unknown')} as organ from documents")
def domain_and_organ_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", domain_first(F.col("text")).alias("domain"), organ_first(F.col("text")).alias("organ"))


_TM = {m: any_sql("t", ps) for m, ps in lexicon.TEXT_MODALITIES.items()}


@query(f"""with h as (select o_orderkey, t, st, {_TM['rna']} as r, {_TM['atac']} as a, {_TM['multiome']} as m, {_TM['cite']} as c from
(select o_orderkey, lower(o_orderpriority || case o_orderkey % 5 when 0 then ' snRNA joint profiling' when 1 then ' single cell ATAC' when 2 then ' CITE-seq' else ' bulk' end) as t,
case o_orderkey % 2 when 0 then '{lexicon.EXPRESSION_TYPE}' else 'Other;{lexicon.BINDING_TYPE}' end as st from orders))
select o_orderkey, array_to_string(list_filter([case when a or m or contains(st, '{lexicon.BINDING_TYPE}') then 'atac' end, case when c then 'cite' end, case when m then 'multiome' end,
case when r or m or (contains(st, '{lexicon.EXPRESSION_TYPE}') and not c) then 'rna' end], lambda x: x is not null), ',') as modalities from h""")
def modalities_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat("o_orderpriority", F.when(k % 5 == 0, " snRNA joint profiling").when(k % 5 == 1, " single cell ATAC").when(k % 5 == 2, " CITE-seq").otherwise(" bulk"))
    kind = F.when(k % 2 == 0, lexicon.EXPRESSION_TYPE).otherwise(f"Other;{lexicon.BINDING_TYPE}")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(modalities_of_text(text, kind), ",").alias("modalities"))


_SIGNALS = ", ".join(f"case when contains(t, {quoted(s)}) then {quoted(m)} end" for s, m in lexicon.ASSAY_SIGNALS)
_TYPES = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in lexicon.SERIES_TYPES.items())


@query(f"""with x as (select o_orderkey, lower(o_orderpriority || case o_orderkey % 4 when 0 then ' Visium and scATAC' when 1 then ' 10x Genomics Multiome' else '' end) as t, string_split('{lexicon.EXPRESSION_TYPE}; other' || case when o_orderkey % 3 = 0 then ';unknown' else '' end, ';') as st from orders),
y as (select o_orderkey, list_filter(list_concat(list_transform(st, lambda p: case lower(trim(p)) {_TYPES} end), [{_SIGNALS}]), lambda x: x is not null) as l from x)
select o_orderkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') as modalities from y""")
def modalities_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat("o_orderpriority", F.when(k % 4 == 0, " Visium and scATAC").when(k % 4 == 1, " 10x Genomics Multiome").otherwise(""))
    kind = F.concat(F.lit(f"{lexicon.EXPRESSION_TYPE}; other"), F.when(k % 3 == 0, ";unknown").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(modalities_in_order(kind, text), ",").alias("modalities"))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) = 1")
def accession_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return first_wins(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_suppkey")


@query("""select o_orderkey, 'https://ftp.ncbi.nlm.nih.gov/geo/series/' || case when length(o_orderkey::varchar) > 3 then 'GSE' || left(o_orderkey::varchar, length(o_orderkey::varchar) - 3) || 'nnn' else 'GSEnnn' end || '/GSE' || o_orderkey || '/' as ftp_link from orders""")
def ftp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", listing_folder(F.concat(F.lit("GSE"), "o_orderkey")).alias("ftp_link"))


@query("""select o_orderkey, case o_orderkey % 8 when 0 then 'Homo sapiens' when 1 then 'Mus musculus' when 2 then 'Rattus norvegicus' when 3 then 'Danio rerio' when 4 then 'Drosophila melanogaster' when 5 then 'Caenorhabditis elegans' when 6 then 'Yeast' else '' end as organism,
case when o_orderkey % 2 = 0 then 'Homo sapiens' else 'Mus musculus' end as parsed, case o_orderkey % 3 when 0 then 'scATAC-seq' when 1 then 'Spatial' else '' end as assay,
case o_orderkey % 4 when 0 then 'timeout' when 1 then 'oom' when 2 then 'http_error' else 'error' end as failure from orders""")
def names_and_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % n + 1).cast("int"))
    name = at(8, "human", "Mouse", "rat", "ZEBRAFISH", "fly", "worm", "Yeast", "")
    q = F.concat(at(2, "Human ", "mouse and rat "), at(3, "scATAC-seq or CITE-seq", "spatial scRNA", "bulk"))
    failure = failure_class(at(4, "Read timeout", "CUDA out of memory", "500 server", "odd"), at(4, "", "", "HTTPError", ""))
    p = parse_query(q)
    return table(spark, sf_dir, "orders").select("o_orderkey", organism_name(name).alias("organism"), p["organism"].alias("parsed"), p["assay"].alias("assay"), failure.alias("failure"))


@query("""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all('GSE' || n_chars || ' and [GSE' || doc_id || '] or GSE12; gse9 ' || 'GSE' || doc_id, '(GSE\\d+)', 1))), ',') as cited from documents""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("GSE"), "n_chars", F.lit(" and [GSE"), "doc_id", F.lit("] or GSE12; gse9 GSE"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(series_ids(text), ",").alias("cited"))


@query("""select o_orderkey, case when b = 0 then '0 B' when b < 1024 then printf('%.1f B', b::double) when b < 1048576 then printf('%.1f KB', b / 1024.0::double) when b < 1073741824 then printf('%.1f MB', b / 1048576.0::double)
when b < 1099511627776 then printf('%.1f GB', b / 1073741824.0::double) else printf('%.1f TB', b / 1099511627776.0::double) end as size_text from (select o_orderkey, (o_orderkey % 5) * (o_orderkey * 7 + 3) * (o_orderkey % 7) * 1025 as b from orders)""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", format_bytes((k % 5) * (k * 7 + 3) * (k % 7) * 1025).alias("size_text"))


@query("""with t as (select p_partkey, p_brand, '/data/' || p_brand || case p_partkey % 3 when 0 then '' else '/' || p_type end as path from part), e as (select p_brand, '/data/' || p_brand || case when p_size > 25 then '/old' else '/' || p_type end as path from part where p_partkey % 5 = 0)
select p_partkey from t where not exists (select 1 from e where e.p_brand = t.p_brand and e.path != t.path and not starts_with(e.path, t.path || '/') and not starts_with(t.path, e.path || '/'))""")
def path_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    base = F.concat(F.lit("/data/"), "p_brand")
    targets = p.select("p_partkey", F.upper("p_brand").alias("series_id"), F.when(F.col("p_partkey") % 3 == 0, base).otherwise(F.concat(base, F.lit("/"), "p_type")).alias("path"))
    existing = p.where("p_partkey % 5 = 0").select(F.col("p_brand").alias("series_id"), F.when(F.col("p_size") > 25, F.concat(base, F.lit("/old"))).otherwise(F.concat(base, F.lit("/"), "p_type")).alias("path")).distinct()
    return not_elsewhere(targets, existing).select("p_partkey")


_STEM = "regexp_replace(regexp_replace(n, '(matrix\\.mtx|(barcodes|features|genes)\\.tsv)(\\.gz)?$', ''), '^$', '')"


@query(f"""with {FILES_SQL}, x as (select series_id, lower(url) || '' as n, url, case when contains(lower(url), 'matrix.mtx') then 'm' when contains(lower(url), 'barcodes.tsv') then 'b' when contains(lower(url), 'features.tsv') then 'f' end as kind from files),
t as (select series_id, url, kind, list_distinct(list_filter(string_split_regex({_STEM}, '[_\\-.]+'), lambda s: s != '')) as tokens from x where kind is not null),
mb as (select m.series_id, m.url as matrix, b.url as barcodes, len(list_intersect(m.tokens, b.tokens)) as s from t m join t b using (series_id) where m.kind = 'm' and b.kind = 'b' qualify row_number() over (partition by m.series_id, m.url order by s desc, b.url) = 1),
mf as (select m.series_id, m.url as matrix, f.url as features, len(list_intersect(m.tokens, f.tokens)) as s from t m join t f using (series_id) where m.kind = 'm' and f.kind = 'f' qualify row_number() over (partition by m.series_id, m.url order by s desc, f.url) = 1)
select series_id, matrix, barcodes, features, (mb.s + mf.s)::bigint as score from mb join mf using (series_id, matrix) qualify row_number() over (partition by series_id order by mb.s + mf.s desc, matrix) = 1""")
def triplet_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_triplets(files(spark, sf_dir), "series_id", "url").withColumn("score", F.col("score").cast("long"))
