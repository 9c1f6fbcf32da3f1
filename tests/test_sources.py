from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from quarry import runtime
from quarry.queries.engine_flows import ingested_twice
from quarry.sources import matrices, obo, records, soft
from quarry.streaming.ingest import event_counts, ingest_series

SERIES = """^SERIES = GSE1
!Series_title = Old
!Series_title = A title = x
!Series_summary = One.
  !Series_summary = Two.
!Series_type = Expression profiling by high throughput sequencing
!Series_type = Other
!Series_pubmed_id = 7
!Series_pubmed_id = 7
!Series_pubmed_id =
!Series_sample_id = GSM1
!Series_sample_id = GSM2
!Series_sample_count = 2
!Series_submission_date = Jan 1 2020
"""
SAMPLES = """^SAMPLE = GSM1
!Sample_title = first
!Sample_source_name_ch1 = Lung
!Sample_organism_ch1 = Homo sapiens
!Sample_characteristics_ch1 = Tissue: lung
!Sample_characteristics_ch1 = tissue: Left: lung
!Sample_characteristics_ch1 = age=42 years
!Sample_characteristics_ch1 = bare
!Sample_characteristics_ch1 = more bare
!Sample_supplementary_file = ftp://x/a.h5
!Sample_supplementary_file_1 = NONE
^SAMPLE = GSM2
!Sample_title = second
^SAMPLE =
!Sample_title = dropped
^SAMPLE = GSM1
!Sample_title = later wins
"""


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "series_id string, text string")


def test_series(spark):
    r = soft.parse_series(texts(spark, ("GSE1", SERIES))).first()
    assert (r.title, r.summary, r.series_type) == ("A title = x", "One. Two.", "Expression profiling by high throughput sequencing; Other")
    assert (r.pubmed_ids, r.submission_date, r.n_samples, r.overall_design) == (["7"], "Jan 1 2020", 2, "")
    late = SERIES.replace("!Series_sample_count = 2\n", "").replace("!Series_sample_id = GSM1", "!Series_sample_count = 2\n!Series_sample_id = GSM1")
    assert soft.parse_series(texts(spark, ("GSE1", late))).first().n_samples == 4
    assert soft.parse_series(texts(spark, ("GSE1", None), ("GSE2", ""))).select("n_samples").collect() == [(0,), (0,)]


def test_samples(spark):
    rows = {r.sample_id: r for r in soft.parse_samples(texts(spark, ("GSE1", SAMPLES.replace("^SAMPLE = GSM1\n!Sample_title = later wins\n", "")))).collect()}
    assert set(rows) == {"GSM1", "GSM2"}
    assert rows["GSM1"].characteristics == {"tissue": "Left: lung", "age": "42 years", "attr_0": "bare", "attr_1": "more bare"}
    assert rows["GSM1"].supplementary_files == ["ftp://x/a.h5"] and rows["GSM2"].characteristics == {}
    assert [r.title for r in soft.parse_samples(texts(spark, ("GSE1", SAMPLES))).where("sample_id = 'GSM1'").collect()] == ["later wins"]
    assert [r.url for r in soft.supplementary_urls(texts(spark, ("GSE1", SAMPLES))).collect()] == ["ftp://x/a.h5"]
    ids = spark.createDataFrame([(" gse5 ",), ("GSE5",), ("x",), (None,)], "id string")
    assert [r.series_id for r in soft.select_accessions(ids).collect()] == ["GSE5"]


def test_ontology(spark):
    text = '\n'.join(["format-version: 1", "", "[Term]", "id: CL:1", "name: T cell", 'synonym: "T lymphocyte" EXACT []', 'synonym: "x', "", "[Term]", "id: XX:2", "name: other", "", "[Typedef]", "id: CL:9", "name: part", "", "[Term]", "id: CL:3", "name: gone", "is_obsolete: true", "", "[Term]", "id: CL:4", "name: B cell"])
    terms = obo.parse_terms(spark.createDataFrame([("CL", text)], "onto string, text string"))
    assert sorted((r.id, r.name, r.synonyms) for r in terms.collect()) == [("CL:1", "T cell", ["T lymphocyte"]), ("CL:4", "B cell", [])]
    assert [r.syn for r in obo.synonyms_of(terms).collect()] == ["T lymphocyte"]


def test_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<Set><PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><ArticleTitle>Title</ArticleTitle><Abstract><AbstractText Label="AIM">Why.</AbstractText><AbstractText Label="END">So.</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D1">Lung</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></Set>')
    r = records.read_articles(spark, str(tmp_path / "a.xml")).first()
    assert (r.pmid, r.title, r.abstract, r.mesh_terms, r.keywords) == ("11", "Title", "AIM: Why. END: So.", ["Lung"], [])
    (tmp_path / "s.xml").write_text('<R><DocSum><Id>200000123</Id><Item Name="Accession" Type="String">GDS1</Item><Item Name="n_samples" Type="Integer">4</Item><Item Name="PubMedIds" Type="List"><Item Name="int" Type="Integer">9</Item></Item><Item Name="title" Type="String">T</Item></DocSum><DocSum><Id>5</Id><Item Name="Accession" Type="String">GSE12345</Item></DocSum><DocSum><Id>6</Id><Item Name="Accession" Type="String">GPL1</Item></DocSum></R>')
    hits = {r.series_id: r for r in records.series_hits(records.read_summaries(spark, str(tmp_path / "s.xml"))).collect()}
    assert set(hits) == {"GSE000123", "GSE12345"} and hits["GSE000123"].n_samples == 4 and hits["GSE000123"].pubmed_ids == ["9"]
    assert hits["GSE12345"].ftp_link.endswith("/series/GSE12nnn/GSE12345/")
    page = "<a href='a.h5'>a</a><a href=\"/up\">u</a><A class=x HREF='?C=N'>s</a><a href='http://x/y'>o</a><a href=''>e</a>"
    got = records.listed_files(spark.createDataFrame([("GSE1", page)], "series_id string, html string")).collect()
    assert [r.url for r in got] == ["https://ftp.ncbi.nlm.nih.gov/geo/series/GSEnnn/GSE1/suppl/a.h5"]
    index = spark.createDataFrame([('{"gse_folder_index": {"GSE2": 1, "GSE1": 2}, "GSE9": 3}',), ('{"GSE4": 1, "sub": {"GSE5": 2, "x": 3}}',)], "value string")
    assert sorted(r.series_id for r in records.accession_index(index).collect()) == ["GSE1", "GSE2", "GSE4", "GSE5"]


def test_studies_of_both_shapes(spark, tmp_path):
    nested = {"gse_id": "GSE1", "title": "A", "n_samples": 3, "characteristics_summary": {"tissues": ["lung"], "donor_count": 2}, "pubmed": {"pmid": "1", "abstract": "x"}}
    flat = {"gse_id": "GSE2", "tissues": ["liver"], "sample_count": 5, "pubmed": [{"pmid": "2"}, {"pmid": "3"}], "document_text": "doc"}
    for i, s in enumerate((nested, flat)):
        (tmp_path / f"{i}.json").write_text(json.dumps(s, indent=1))
    (tmp_path / "bad.json").write_text("{not json")
    rows = {r.gse_id: r for r in records.read_studies(spark, str(tmp_path)).collect()}
    assert set(rows) == {"GSE1", "GSE2"}
    assert rows["GSE1"].tissues == ["lung"] and rows["GSE1"].pubmed.pmid == "1" and rows["GSE1"].donor_count == 2
    assert rows["GSE2"].tissues == ["liver"] and rows["GSE2"].pubmed.pmid == "2" and rows["GSE2"].n_samples == 5 and rows["GSE2"].title == ""


def test_matrix_files(spark, tmp_path):
    d = tmp_path / "m"
    d.mkdir()
    (d / "matrix.mtx").write_text("%%MatrixMarket\n%c\n2 3 3\n1 1 5\n2 3 7\n1 2 1\n")
    (d / "barcodes.tsv").write_text("c1\nc2\nc1\n")
    (d / "features.tsv").write_text("g1\tGene\ng2\t\n")
    got = sorted(tuple(r) for r in matrices.read_triplet(spark, str(d / "matrix.mtx"), str(d / "barcodes.tsv"), str(d / "features.tsv")).collect())
    assert got == [("c1", "Gene", 5.0), ("c1-1", "g2", 7.0), ("c2", "Gene", 1.0)]
    (d / "t.csv").write_text("id;a;b\nx;1;0\ny;2.5;3\n")
    assert sorted(tuple(r) for r in matrices.read_table(spark, str(d / "t.csv")).collect()) == [("x", "a", 1.0), ("y", "a", 2.5), ("y", "b", 3.0)]
    (d / "dataset_meta.json").write_text("{}")
    assert {r.name: r.format for r in matrices.scan_folder(spark, str(d)).collect()} == {"matrix.mtx": "mtx", "barcodes.tsv": "tsv", "features.tsv": "tsv", "t.csv": "csv"}
    p = spark.createDataFrame([("/a/gse1_x",), ("/b/GSE1",), ("/b/none",)], "path string")
    assert [(r.series_id, r.paths) for r in matrices.series_folders(p).collect()] == [("GSE1", ["/a/gse1_x", "/b/GSE1"])]


class _Runs(StreamingQueryListener):
    """Groups of the jobs of streams."""

    def __init__(self):
        self.groups = []

    def onQueryStarted(self, event):
        self.groups.append(str(event.runId))

    def onQueryProgress(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def test_ingestion_has_few_tasks_for_many_small_files(spark, tmp_path):
    landed, out = tmp_path / "in", str(tmp_path / "out")
    landed.mkdir()
    for i in range(300):
        (landed / f"GSE{i}.soft").write_text(SERIES)
    settings = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    former = [spark.conf.get(k) for k in settings]
    runs, parts = _Runs(), []
    spark.streams.addListener(runs)
    try:
        ingest_series(spark, str(landed), out, str(tmp_path / "mark"), transform=lambda b: parts.append(b.rdd.getNumPartitions()) or soft.parse_series(b))
    finally:
        spark.streams.removeListener(runs)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for g in runs.groups for j in tracker.getJobIdsForGroup(g)]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= 64  # a task for each file to list them, before
    assert parts and max(parts) <= 4  # one for 32 files to read them
    assert [spark.conf.get(k) for k in settings] == former
    assert spark.read.parquet(out).count() == 300


def test_records_are_landed_by_many_tasks(spark):
    assert ingested_twice(spark, "/root/testdata/sf0.01").count() == 100
    place = Path(runtime._roots[-1].removeprefix("file://"))
    assert len(list((place / "second").glob("part-*.parquet"))) > 8  # one, before


def test_ingestion_unpacks_what_the_reader_of_texts_unpacks(spark, tmp_path):
    landed, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    landed.mkdir()
    text = lambda n: f"^SERIES = GSE{n}\n!Series_title = é {n}\n"
    (landed / "GSE1.soft").write_text(text(1))
    for n, kind in enumerate(("gzip", "bzip2", "deflate", "lz4", "snappy"), 2):
        spark.createDataFrame([(text(n),)], "value string").coalesce(1).write.option("compression", kind).text(str(tmp_path / kind))
        (part,) = (tmp_path / kind).glob("part-*")
        part.rename(landed / f"GSE{n}.soft{part.suffix}")
    (landed / "GSE9.soft").write_bytes(b"!Series_title = \xff\r\n")
    (landed / "GSE10.soft").write_text("")
    for _ in range(2):
        ingest_series(spark, str(landed), out, mark)
    got = {r.series_id: bytes(r.title) for r in spark.read.parquet(out).select("series_id", F.col("title").cast("binary").alias("title")).collect()}
    assert got == {f"GSE{n}": f"é {n}".encode() for n in range(1, 7)} | {"GSE9": "\ufffd".encode()}


def test_ingestion_takes_each_file_once(spark, tmp_path):
    landed, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    landed.mkdir()
    (landed / "GSE1.soft").write_text(SERIES)
    ingest_series(spark, str(landed), out, mark)
    (landed / "GSE2.soft").write_text(SERIES)
    (landed / "gse1_again.soft").write_text(SERIES)
    ingest_series(spark, str(landed), out, mark)
    ingest_series(spark, str(landed), out, mark)
    assert sorted(r.series_id for r in spark.read.parquet(out).collect()) == ["GSE1", "GSE2"]
    e = spark.createDataFrame([("2020-01-01 01:00:00", "a", 1.0), ("2020-01-01 05:00:00", "a", 2.0), ("2020-01-02 05:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.events, r.value) for r in event_counts(e).collect()) == [(1, 4.0), (2, 3.0)]
