"""Conversion of folders: every format, archives, errors as rows, placement and summaries."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import load_config
from quarry.engine import Engine
from quarry.operators.matrix import quality_filter
from quarry.plans import convert
from quarry.providers import ModelEncoder, encoder_name, pick_device
from quarry.sources import hdf5
from quarry.sources.hdf5_writer import write_matrices


class Data:
    """A dataset of h5py's interface over an array."""

    def __init__(self, a):
        self.a = np.array(a, dtype="S8") if np.array(a).dtype.kind == "U" else np.array(a)
        self.shape = self.a.shape

    def __getitem__(self, k):
        return self.a[k]


class Group(dict):
    def __init__(self, items, **attrs):
        super().__init__(items)
        self.attrs = attrs

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def named(*names):
    return Group({"_index": Data(list(names))}, _index="_index")


SPARSE = {"data": Data([1.0, 2.0, 3.0]), "indices": Data([0, 1, 1]), "indptr": Data([0, 1, 3])}  # two rows or columns of three
WANT = {("c0", "g0", 1.0), ("c1", "g1", 2.0), ("c1", "g2", 3.0)}


def rows(f, kind):
    return {tuple(r) for b in hdf5.matrix_blocks(f, kind) for r in b.itertuples(index=False)}


@pytest.mark.parametrize("size", [1, 2, 1 << 18])
def test_hdf5_layouts(monkeypatch, size):
    monkeypatch.setattr(hdf5, "SLICE", size)
    sparse = SPARSE | {"indices": Data([0, 1, 2])}
    tenx = {**sparse, "shape": Data([3, 2]), "barcodes": Data(["c0", "c1"])}
    v3 = Group({"matrix": Group(tenx | {"features": Group({"name": Data(["g0", "g1", "g2"]), "id": Data(["i0", "i1", "i2"])})})})
    v2 = Group({"mm10": Group(tenx | {"gene_names": Data(["g0", "g1", "g2"]), "genes": Data(["i0", "i1", "i2"])})})
    ids = Group({"matrix": Group(tenx | {"features": Group({"name": Data(["g0"]), "id": Data(["g0", "g1", "g2"])})})})
    dense = [[1.0, 0, 0], [0, 2.0, 3.0]]
    ann = {"obs": named("c0", "c1"), "var": named("g0", "g1", "g2")}
    loom = Group({"matrix": Data(np.array(dense).T), "row_attrs": {"Gene": Data(["g0", "g1", "g2"])}, "col_attrs": {"CellID": Data(["c0", "c1"])}})
    assert rows(v3, "h5_10x") == rows(v2, "h5_other") == rows(ids, "h5_10x") == WANT
    assert rows(Group(ann | {"X": Data(dense)}), "h5ad") == rows(loom, "loom") == WANT
    assert rows(Group(ann | {"X": Group(sparse, **{"encoding-type": "csr_matrix", "shape": (2, 3)})}), "h5_other") == WANT
    csc = {"data": Data([1.0, 2.0, 3.0]), "indices": Data([0, 1, 1]), "indptr": Data([0, 1, 2, 3])}
    assert rows(Group(ann | {"X": Group(csc, **{"encoding-type": "csc_matrix", "shape": (2, 3)})}), "h5ad") == WANT
    assert rows(Group({"m": Data(dense)}), "h5_other") == {(c[1:], g[1:], v) for c, g, v in WANT}
    with pytest.raises(ValueError):
        rows(Group({"x": Group({})}), "h5_other")
    assert hdf5.hdf5_kind(["X", "obs"]) == "h5ad" and hdf5.hdf5_kind(["GRCh38"]) == "h5_10x" and hdf5.hdf5_kind([]) == "h5_other"
    assert hdf5.unique_names(["x", "x", "x-1", "x"]) == ["x", "x-2", "x-1", "x-3"]


def fake_opener(path):
    text = open(path, "rb").read()
    if text == b"bad":
        raise OSError("no HDF5")
    if path.endswith(".h5ad"):
        return Group({"X": Data([[8.0]]), "obs": named("p"), "var": named("s")})
    return Group({"matrix": Group(SPARSE | {"shape": Data([2, 2]), "barcodes": Data(["b0", "b1"]), "genes": Data(["G", "G"])})})


def member(t, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    t.addfile(info, io.BytesIO(data))


@pytest.fixture
def folder(tmp_path):
    one, two, three = (tmp_path / "in" / g for g in ("GSE1", "GSE2 b", "GSE3"))
    for d in (one, two, three):
        d.mkdir(parents=True)
    (one / "a+b.csv").write_text('"id","x,1","y"\r\n"p",1,0\r\n\r\n"q",0,"2.5"\r\n')
    (one / "wide.tsv").write_text("\t".join(["h", *(f"c{i}" for i in range(12))]) + "\n" + "\t".join(["G1", *map(str, range(12))]) + "\n")
    (one / "corner.txt.gz").write_bytes(gzip.compress(b"g1 x;g2\nr;3;text\n"))
    for p, extra in (("s1_", ""), ("s2_", "7\n")):
        (two / f"{p}matrix.mtx").write_text("%%MatrixMarket\n%c\n2 2 2\n1 1 5\n2 2 2\n" + ("1 2 " + extra if extra else ""))
        (two / f"{p}barcodes.tsv").write_text("A\nA\n")
        (two / f"{p}features.tsv.gz").write_bytes(gzip.compress(b"i1\tF\ni2\tF\n"))
    (two / "lone.mtx.gz").write_bytes(gzip.compress(b"1 1 1"))
    (two / "x.h5").write_bytes(b"good")
    (two / "y.h5").write_bytes(b"bad")
    (two / "z.h5ad.gz").write_bytes(gzip.compress(b"good"))
    with tarfile.open(three / "raw.tar.gz", "w:gz") as t:
        member(t, "0.csv", b"id,n\n")
        member(t, "1.csv", b"id,n\nk,4\n")
        member(t, "2.csv", b"id,n\nk,9\n")
        member(t, "../evil.csv", b"id,n\nk,1\n")
    (three / "cut.tar").write_bytes(b"no archive")
    (three / "empty.csv").write_text("")
    return str(tmp_path / "in")


def test_every_format_in_one_plan(spark, folder):
    made, results = convert.convert_folder(spark, folder, fake_opener)
    got = {}
    for r in made.collect():
        got.setdefault((r.series_id, r["sample"]), set()).add((r.cell, r.gene, r.value))
    assert got.pop(("GSE1", "wide.tsv")) == {(f"c{i}", "G1", float(i)) for i in range(1, 12)}
    assert got == {
        ("GSE1", "a+b.csv"): {("p", "x,1", 1.0), ("q", "y", 2.5)},
        ("GSE1", "corner.txt.gz"): {("r", "g1 x", 3.0)},
        ("GSE2", "s1_matrix.mtx"): {("A", "F", 5.0), ("A-1", "F-1", 2.0)},
        ("GSE2", "s2_matrix.mtx"): {("A", "F", 5.0), ("A-1", "F-1", 2.0), ("A-1", "F", 7.0)},
        ("GSE2", "x.h5"): {("b0", "G", 1.0), ("b1", "G-1", 2.0), ("b1", "G-1", 3.0)},
        ("GSE2", "z.h5ad"): {("p", "s", 8.0)},
        ("GSE3", "1.csv"): {("k", "n", 4.0)},
    }
    errors = {r["sample"]: r.error for r in results.where("error is not null").collect()}
    assert set(errors) == {"y.h5", "lone.mtx.gz", "0.csv", "cut.tar"}  # Spark's scans pass over files of no bytes
    assert errors["y.h5"] == "OSError: no HDF5" and errors["0.csv"] == "no values" and "ReadError" in errors["cut.tar"]
    every = convert.convert_folder(spark, folder, fake_opener, first_of_archive=False)[0]
    assert {r["sample"] for r in every.where("series_id = 'GSE3'").collect()} == {"1.csv", "2.csv"}
    total = convert.totals_by_series(results).first()
    assert tuple(total) == (3, 3, 0, ["GSE1", "GSE2", "GSE3"])


def test_without_h5py_files_are_named_not_skipped(spark, tmp_path):
    (tmp_path / "GSE9").mkdir()
    (tmp_path / "GSE9" / "m.loom").write_bytes(b"x")
    made, results = convert.convert_folder(spark, str(tmp_path))
    assert made.count() == 0 and results.first().error


def test_placement_and_summary(spark, tmp_path, folder):
    e = Engine(spark, replace(load_config(env={}), root=str(tmp_path / "out")))
    first = {r.series_id: r.entries for r in e.place_matrices(folder).collect()}
    assert first["GSE3"] == 1 and set(first) == {"GSE1", "GSE2", "GSE3"}
    assert e.place_matrices(folder).count() == 0
    open(f"{folder}/GSE3/new.csv", "w").write("id,n\nk,4\n")
    assert {r.series_id: r.entries for r in e.place_matrices(folder).collect()} == {"GSE3": 2}
    kept = spark.read.parquet(e.config.path("canonical")).groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in kept} == first | {"GSE3": 2}
    summary = [json.loads(x) for p in (tmp_path / "out" / "conversion_summary").glob("*.json") for x in p.read_text().splitlines()]
    assert summary[0]["total"] == 3 and summary[0]["generated_at"]
    assert spark.read.json(e.config.path("manifests")).count() == 3
    assert e.place_matrices(folder, meta_only=True).count() == 0


def test_quality_limits_hold_within_each_file(spark):
    m = spark.createDataFrame([("f", "c", "g", 1.0), ("h", "c", "k", 1.0)], "source string, cell string, gene string, value double")
    assert quality_filter(m, 2, 1).count() == 2
    assert quality_filter(m, 2, 1, within=["source"]).count() == 0


def test_models_load_once_and_fall_back(spark):
    loads = []

    def load(device):
        loads.append(device)
        if device != "cpu":
            raise RuntimeError("out of memory")
        return lambda texts: [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    e = ModelEncoder("m1", load)
    assert e.encode("x") == [0.6, 0.8] and e.encode("") == [0.0, 0.0] and loads == ["cpu"]
    assert pick_device("cuda", lambda d: d == "mps") == "mps" and pick_device("cpu") == "cpu" and pick_device("auto", lambda d: True) == "cuda"
    assert encoder_name(e) != encoder_name(ModelEncoder("m2", load))


def test_folders_without_tables_are_listed_once_and_files_are_dealt(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"GSE{i}", "c", f"g{j}", float(j)) for i in range(6) for j in (1, 2)], "series_id string, cell string, gene string, value double")
    write_matrices(rows, f"file:{tmp_path}/in").collect()
    asked = []
    monkeypatch.setattr(convert, "scan_lines", lambda *a: asked.append(a))
    entries, results = convert.convert_folder(spark, f"file:{tmp_path}/in")
    assert not asked
    assert {(r.series_id, r.gene, r.value) for r in entries.collect()} == {(f"GSE{i}", f"g{j}", float(j)) for i in range(6) for j in (1, 2)}
    assert results.where("error is null and entries = 2").count() == 6
    files = spark.createDataFrame([(f"x{i}", "h5_other") for i in range(64)], "path string, format string")
    seen = hdf5.sniff_formats(files, str).select(F.spark_partition_id().alias("task")).distinct().count()
    assert seen > 8
