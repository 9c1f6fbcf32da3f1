"""HDF5 files as bytes: the oldest form by the writer, the newer one built here, slices over tasks, and errors that name what isn't read."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from quarry.engine import Engine
from quarry.plans.convert import convert_folder, reachable
from quarry.sources import hdf5
from quarry.sources.hdf5_format import FormatError, lzf, open_file
from quarry.sources.hdf5_writer import Writer, matrix_file, write_matrices

NONE = b"\xff" * 8


def opened(tmp_path, data, name="f.h5"):
    (tmp_path / name).write_bytes(data)
    return open_file(str(tmp_path / name))


def test_types_shapes_and_deep_trees(tmp_path):
    r = np.random.default_rng(1)
    wide = {f"n{i:03}": np.array([i]) for i in range(50)}  # several symbol table nodes
    given = {
        "a": r.integers(-(2**60), 2**60, 5000),
        "b": r.normal(size=(130, 7)),
        "c": {"d": r.normal(size=321).astype(np.float32), "e": r.integers(0, 200, (9, 3, 4)).astype(np.uint8), **wide},
        "s": ["x", "", "naïve", "long text " * 5],
        "none": np.empty(0, np.int32),
    }
    for chunk, shuffle in ((16, True), (1 << 15, False)):
        with opened(tmp_path, Writer(chunk, shuffle=shuffle).finish(given)) as f:
            assert list(f) == sorted(given) and set(f["c"]) == set(given["c"]) and "zz" not in f["c"]
            for key, want in (("a", given["a"]), ("b", given["b"])):
                d = f[key]
                assert d.shape == want.shape and (d[:] == want).all() and d[:].dtype == want.dtype
                for a, b in ((0, 1), (3, 100), (127, 130), (5, 5)):
                    assert (d[a:b] == want[a:b]).all()
            assert (f["c"]["d"][:] == given["c"]["d"]).all() and (f["c"]["e"][2:9] == given["c"]["e"][2:9]).all() and f["c"]["n049"][0] == 49
            assert [x.decode() for x in f["s"][:].tolist()] == given["s"] and f["none"][:].shape == (0,)
    assert len(opened(tmp_path, Writer(16).finish(given))["a"].chunks) == 313  # two levels of the tree


class Newer:
    """A file in the newer form: superblock 2, headers with checksums, link messages."""

    def __init__(self):
        self.out = bytearray(48)

    def put(self, block):
        at = len(self.out)
        self.out += block
        return at

    def header(self, messages, split=False):
        body = [struct.pack("<BHB", k, len(d), 0) + d for k, d in messages]
        first, rest = (body[:1], body[1:]) if split else (body, [])
        if split:  # the others stand in a continuation block
            block = b"OCHK" + b"".join(rest) + bytes(4)
            first.append(struct.pack("<BHB", 0x10, 16, 0) + struct.pack("<QQ", self.put(block), len(block)))
        data = b"".join(first)
        return self.put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(data)) + data + bytes(4))

    def group(self, items, attributes=()):
        links = [(0x06, bytes([1, 0, len(k)]) + k.encode() + struct.pack("<Q", at)) for k, at in items.items()]
        return self.header([(0x02, bytes([0, 0]) + NONE + NONE), *links, *attributes], split=len(links) > 1)

    def space(self, *shape):
        return bytes([2, len(shape), 0, 1]) + b"".join(struct.pack("<Q", n) for n in shape)

    F4 = struct.pack("<BBBBI", 0x11, 0x20, 31, 0, 4) + struct.pack("<HHBBBBI", 0, 32, 23, 8, 0, 23, 127)
    I8 = struct.pack("<BBBBI", 0x10, 8, 0, 0, 8) + struct.pack("<HH", 0, 64)
    TEXT = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)

    def texts(self, *words):
        """References to a global heap."""
        objects = b"".join(struct.pack("<HH4xQ", i + 1, 1, len(w.encode())) + w.encode() + bytes(-len(w.encode()) % 8) for i, w in enumerate(words))
        at = self.put(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", 16 + len(objects)) + objects)
        return b"".join(struct.pack("<IQI", len(w.encode()), at, i + 1) for i, w in enumerate(words))

    def attribute(self, name, kind, shape, data):
        n = name.encode() + b"\0"
        return 0x0C, bytes([3, 0]) + struct.pack("<HHHB", len(n), len(kind), len(self.space(*shape)), 1) + n + kind + self.space(*shape) + data

    def dataset(self, kind, shape, layout, filters=b""):
        return self.header([(0x01, self.space(*shape)), (0x03, kind), *([(0x0B, filters)] if filters else []), (0x08, layout)])

    def finish(self, root):
        self.out[:48] = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + struct.pack("<Q", 0) + NONE + struct.pack("<QQ", len(self.out), root) + bytes(4)
        return bytes(self.out)


def newer_h5ad(matrix, fixed=False):
    """An annotated matrix of the newer form: texts in heaps, attributes, contiguous, compact and newly indexed chunks."""
    w, x = Newer(), np.asarray(matrix, np.float32)
    compact = lambda data: bytes([3, 0]) + struct.pack("<H", len(data)) + data
    axis = lambda names: w.group({"names": w.dataset(w.TEXT, (len(names),), compact(w.texts(*names)))}, [w.attribute("_index", w.TEXT, (), w.texts("names"))])
    r, c = np.nonzero(x)
    starts = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(x)))]).astype("<i8").tobytes()
    data = x[r, c].astype("<f4")
    if fixed:  # chunks of two elements in a fixed array
        padded = np.zeros(-(-len(data) // 2) * 2, "<f4")
        padded[: len(data)] = data
        at = [w.put(padded[i : i + 2].tobytes()) for i in range(0, len(padded), 2)]
        block = b"FADB" + bytes([0, 0]) + bytes(8) + b"".join(struct.pack("<Q", a) for a in at)
        index = w.put(b"FAHD" + bytes([0, 0, 8, 10]) + struct.pack("<QQ", len(at), w.put(block)) + bytes(4))
        data_layout = bytes([4, 2, 0, 2, 4]) + struct.pack("<II", 2, 4) + bytes([3, 10]) + struct.pack("<Q", index)
    else:
        data_layout = bytes([4, 2, 0, 2, 4]) + struct.pack("<II", len(data), 4) + bytes([1]) + struct.pack("<Q", w.put(data.tobytes()))
    at = w.put(c.astype("<i8").tobytes())
    sparse = w.group(
        {"data": w.dataset(w.F4, (len(data),), data_layout), "indices": w.dataset(w.I8, (len(c),), bytes([3, 1]) + struct.pack("<QQ", at, 8 * len(c))), "indptr": w.dataset(w.I8, (len(x) + 1,), compact(starts))},
        [w.attribute("encoding-type", w.TEXT, (), w.texts("csr_matrix")), w.attribute("shape", w.I8, (2,), struct.pack("<qq", *x.shape))],
    )
    return w.finish(w.group({"X": sparse, "obs": axis([f"c{i}" for i in range(x.shape[0])]), "var": axis([f"g{i}" for i in range(x.shape[1])])}))


MATRIX = [[1.0, 0, 0], [0, 2.0, 3.0], [0, 0, 4.5]]
WANT = {("c0", "g0", 1.0), ("c1", "g1", 2.0), ("c1", "g2", 3.0), ("c2", "g2", 4.5)}


@pytest.mark.parametrize("fixed", [False, True])
def test_newer_files(tmp_path, fixed):
    with opened(tmp_path, newer_h5ad(MATRIX, fixed)) as f:
        assert hdf5.hdf5_kind(list(f)) == "h5ad" and f["X"].attrs["encoding-type"] == b"csr_matrix" and f["X"].attrs["shape"].tolist() == [3, 3]
        assert {tuple(r) for b in hdf5.matrix_blocks(f, "h5_other") for r in b.itertuples(index=False)} == WANT


def test_what_is_not_read_is_named(tmp_path):
    for data, what in ((b"no file", "no HDF5 file"), (Writer().finish({"a": np.arange(9)})[:-200], "the file ends"), (b"\x89HDF\r\n\x1a\n" + bytes([9]) + bytes(200), "superblock version 9")):
        with pytest.raises(FormatError, match=what):
            opened(tmp_path, data)["a"][:]
    w = Newer()
    lzip = bytes([2, 1]) + struct.pack("<HHHH", 4, 0, 0, 0)
    bad = {"f": w.dataset(w.F4, (2,), bytes([4, 2, 0, 2, 4]) + struct.pack("<II", 2, 4) + bytes([1]) + struct.pack("<Q", 0), lzip), "t": w.dataset(w.F4, (2,), bytes([4, 2, 0, 2, 4]) + struct.pack("<II", 2, 4) + bytes([5]) + struct.pack("<Q", 0))}
    f = opened(tmp_path, w.finish(w.group(bad)))
    for key, what in (("f", "filter 4"), ("t", "version 2 B-tree")):
        with pytest.raises(FormatError, match=what):
            f[key][:]


def test_lzf_copies_that_run_into_themselves():
    assert lzf(bytes([2]) + b"abc" + bytes([0b11100000, 4, 2]) + bytes([0b00100000, 0])) == b"abc" + b"abcabcabcabca" + b"aaa"
    assert lzf(b"") == b""


def small(cells, per, chunk):
    r = np.random.default_rng(3)
    rows = [(f"c{i}", f"g{g}", float(1 + r.integers(9))) for i in range(cells) for g in sorted(r.choice(40, per, replace=False).tolist())]
    starts = np.arange(cells + 1) * per
    return rows, matrix_file([f"c{i}" for i in range(cells)], [f"g{i}" for i in range(40)], starts, np.array([int(g[1:]) for _, g, _ in rows]), np.array([v for *_, v in rows], np.float32), chunk)


def test_one_file_is_dealt_over_tasks_by_chunks(spark, tmp_path):
    rows, data = small(500, 6, chunk=64)
    (tmp_path / "big.h5").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "big.h5"), "h5_10x"), (str(tmp_path / "none.h5"), "h5_10x")], "path string, format string")
    got = hdf5.read_hdf5(files, reachable, tasks=5, size=200)
    assert got.rdd.getNumPartitions() > 2
    assert sum(n > 0 for n in got.rdd.glom().map(len).collect()) > 2
    good = got.where("error is null").collect()
    assert sorted((r.cell, r.gene, r.value) for r in good) == sorted(rows)
    assert [r.path for r in got.where("error is not null").collect()] == [str(tmp_path / "none.h5")]
    f = open_file(str(tmp_path / "big.h5"))
    cut = hdf5.Matrix(f, "h5_10x", 200).stored.slices()
    assert all(a % 64 == 0 for a, _ in cut) and cut[-1][1] == 3000


def test_folders_with_files_told_by_content(spark, tmp_path):
    for series in ("GSE1", "GSE2", "GSE3"):
        (tmp_path / series).mkdir()
    rows, data = small(20, 3, chunk=16)
    (tmp_path / "GSE1" / "plain.h5").write_bytes(data)
    (tmp_path / "GSE2" / "really_annotated.h5").write_bytes(newer_h5ad(MATRIX))
    (tmp_path / "GSE3" / "cut.h5").write_bytes(data[:300])
    (tmp_path / "GSE3" / "table.loom").write_bytes(Writer().finish({"matrix": np.array(MATRIX).T, "row_attrs": {"Gene": ["g0", "g1", "g2"]}, "col_attrs": {"CellID": ["c0", "c1", "c2"]}}))
    made, results = convert_folder(spark, str(tmp_path))
    got = {}
    for r in made.collect():
        got.setdefault((r.series_id, r["sample"]), set()).add((r.cell, r.gene, r.value))
    assert got == {("GSE1", "plain.h5"): set(rows), ("GSE2", "really_annotated.h5"): WANT, ("GSE3", "table.loom"): WANT}
    kinds = {r["sample"]: (r.format, r.error) for r in results.collect()}
    assert kinds["plain.h5"] == ("h5_10x", None) and kinds["really_annotated.h5"] == ("h5ad", None) and "the file ends" in kinds["cut.h5"][1]


def test_written_matrices_and_single_files(spark, tmp_path):
    rows = [("GSE1", "a", "x", 1.0), ("GSE1", "a", "x", 2.0), ("GSE1", "b", "y", 5.0), ("GSE2", "a", "z", 7.0)]
    done = write_matrices(spark.createDataFrame(rows, "series_id string, cell string, gene string, value double"), f"file://{tmp_path}/m").collect()
    assert {r.series_id: r.entries for r in done} == {"GSE1": 2, "GSE2": 1}
    e = Engine(spark)
    path = next(r.path for r in done if r.series_id == "GSE1")
    assert {tuple(r) for r in e.read_matrix(path, "h5_10x").collect()} == {("a", "x", 3.0), ("b", "y", 5.0)}
    with pytest.raises(Exception, match="no HDF5 file"):
        (tmp_path / "bad.h5").write_text("nothing")
        e.read_matrix(str(tmp_path / "bad.h5"), "h5_other").collect()
    with pytest.raises(ValueError):
        e.read_matrix("x", "zip")
