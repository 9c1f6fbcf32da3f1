"""Matrices in HDF5 files as (cell, gene, value): 10x, h5ad, loom and plain 2-D data.

A file is opened through the reader of ``hdf5_format``, by byte ranges. Each file is first laid out by one task, which reads its
headers only and cuts its stored entries into slices of whole chunks; then the slices are dealt over all tasks, so that one large file
is read by many. A task holds one slice and the names of one file's cells and genes, whatever the size of the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import Workspace
from quarry.sources.hdf5_format import open_file

SLICE = 1 << 18


def open_hdf5(path: str) -> Any:
    """An open file of a path or of a URI that Arrow's file systems reach."""
    return open_file(path)


def hdf5_kind(keys: list[str]) -> str:
    """What an .h5 file holds, by its top-level keys."""
    if {"matrix", "GRCh38", "mm10"} & set(keys):
        return "h5_10x"
    return "h5ad" if {"X", "obs"} <= set(keys) else "h5_other"


def _names(data: Any) -> list[str]:
    return [x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in data[:].tolist()]


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get -1, -2, ... in order, passing over names that stand already."""
    seen, taken, out = {}, set(names), []
    for n in names:
        if n not in seen:
            seen[n] = 0
            out.append(n)
            continue
        while True:
            seen[n] += 1
            new = f"{n}-{seen[n]}"
            if new not in taken:
                break
        taken.add(new)
        out.append(new)
    return out


def _axis(frame: Any, n: int) -> list[str]:
    """Names of an h5ad axis: the index column that its attributes name."""
    key = frame.attrs.get("_index", "_index")
    key = key.decode() if isinstance(key, bytes) else key
    return _names(frame[key]) if key in frame else [str(i) for i in range(n)]


Block = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Stored:
    """How a matrix lies in its file: ``read(a, b)`` gives (major, minor, value) of stored entries or rows a to b."""

    read: Callable[[int, int], Block]
    total: int
    step: int

    def slices(self) -> list[tuple[int, int]]:
        return [(a, min(a + self.step, self.total)) for a in range(0, self.total, self.step)]


def _whole_chunks(wanted: int, *data: Any) -> int:
    """A length near ``wanted`` that ends where chunks end."""
    chunk = max(getattr(d, "step", 1) for d in data)
    return max(1, wanted // chunk) * chunk


def _compressed(group: Any, size: int) -> Stored:
    """A compressed sparse group, by its entries."""
    starts = np.asarray(group["indptr"][:], dtype=np.int64)
    indices, data = group["indices"], group["data"]

    def read(a: int, b: int) -> Block:
        return np.searchsorted(starts, np.arange(a, b), side="right") - 1, np.asarray(indices[a:b]), np.asarray(data[a:b])

    return Stored(read, int(starts[-1]) if len(starts) else 0, _whole_chunks(size, indices, data))


def _dense(data: Any, size: int) -> Stored:
    rows, columns = data.shape

    def read(a: int, b: int) -> Block:
        part = np.asarray(data[a:b])
        r, c = np.nonzero(part)
        return r + a, c, part[r, c]

    return Stored(read, rows, _whole_chunks(max(1, size // max(1, columns)), data))


def _is_matrix(x: Any) -> bool:
    return len(getattr(x, "shape", ())) == 2


def _text(x: Any) -> str:
    return x.decode() if isinstance(x, bytes) else str(x)


def _layout(f: Any, kind: str, size: int) -> tuple[Stored, bool, list[str], list[str]]:
    """(stored entries, whether rows are cells, names of cells, names of genes) of an open file."""
    if kind == "h5ad" or (kind != "loom" and hdf5_kind(list(f)) == "h5ad"):
        x = f["X"]
        if _is_matrix(x):
            shape, stored, by_cell = x.shape, _dense(x, size), True
        else:
            shape = x.attrs.get("shape", x.attrs.get("h5sparse_shape"))
            form = x.attrs.get("encoding-type", x.attrs.get("h5sparse_format", "csr"))
            stored, by_cell = _compressed(x, size), _text(form).startswith("csr")
        return stored, by_cell, _axis(f["obs"], int(shape[0])), _axis(f["var"], int(shape[1]))
    if kind == "loom":
        genes, cells = f["matrix"].shape
        rows, columns = f["row_attrs"], f["col_attrs"]
        named = lambda g, key, n: _names(g[key]) if key in g else [str(i) for i in range(n)]
        return _dense(f["matrix"], size), False, named(columns, "CellID", cells), named(rows, "Gene", genes)
    for key in f:
        g = f[key]
        if not hasattr(g, "shape") and all(k in g for k in ("data", "indices", "indptr", "shape")):
            n_genes, n_cells = (int(n) for n in g["shape"][:])
            lists = [_names(g["features"][k]) for k in ("name", "id") if k in g["features"]] if "features" in g else [_names(g[k]) for k in ("gene_names", "genes") if k in g]
            genes = next((x for x in lists if len(x) == n_genes), [str(i) for i in range(n_genes)])
            cells = _names(g["barcodes"]) if "barcodes" in g else []
            return _compressed(g, size), True, cells if len(cells) == n_cells else [str(i) for i in range(n_cells)], genes
    for key in f:
        if _is_matrix(f[key]):
            return _dense(f[key], size), True, [str(i) for i in range(f[key].shape[0])], [str(i) for i in range(f[key].shape[1])]
    raise ValueError("no matrix in this file")


class Matrix:
    """An open file's matrix, its names made unique."""

    def __init__(self, f: Any, kind: str, size: int):
        self.stored, self.by_cell, cells, genes = _layout(f, "h5ad" if kind == "h5ad_gz" else kind, size)
        self.cells, self.genes = np.array(unique_names(cells), dtype=object), np.array(unique_names(genes), dtype=object)

    def block(self, a: int, b: int) -> pd.DataFrame:
        """(cell, gene, value) of a slice, without zeros."""
        major, minor, value = self.stored.read(a, b)
        some = value != 0
        c, g = (major, minor) if self.by_cell else (minor, major)
        return pd.DataFrame({"cell": self.cells[c[some]], "gene": self.genes[g[some]], "value": value[some].astype(np.float32).astype(float)})


def matrix_blocks(f: Any, kind: str) -> Iterator[pd.DataFrame]:
    """Blocks of (cell, gene, value) of a whole file."""
    m = Matrix(f, kind, SLICE)
    for a, b in m.stored.slices():
        yield m.block(a, b)


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def _dealt(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Files over a number of tasks that is given: by their paths' bytes Spark would open them all in one."""
    return files.repartition(tasks or 8 * files.sparkSession.sparkContext.defaultParallelism, "path")


def sniff_formats(files: DataFrame, local: Callable[[str], str], opener: Callable[[str], Any] = open_hdf5) -> DataFrame:
    """``files`` (path, format, ...) with the format of .h5 files by what they hold; one that can't be opened keeps its format."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path, kind in zip(b["path"], b["format"], strict=True):
                if kind in ("h5_10x", "h5_other"):
                    try:
                        with opener(local(path)) as f:
                            kind = hdf5_kind(list(f))
                    except Exception:  # reading it later gives the error
                        pass
                found.append(kind)
            yield b.assign(format=found)

    return _dealt(files).mapInPandas(run, files.schema)


def read_hdf5(files: DataFrame, local: Callable[[str], str], opener: Callable[[str], Any] = open_hdf5, tasks: int | None = None, size: int = SLICE) -> DataFrame:
    """(path, cell, gene, value, error) of files (path, format); a file that can't be read is one row with its error.

    A slice has about ``size`` entries, and whole chunks. A file of which a slice breaks has rows and an error; its rows aren't to be used.
    """
    spark = files.sparkSession

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, kind in zip(batch["path"], batch["format"], strict=True):
                try:
                    with opener(local(path)) as f:
                        cut = Matrix(f, kind, size).stored.slices()
                    yield pd.DataFrame({"path": path, "format": kind, "first": [a for a, _ in cut], "last": [b for _, b in cut], "error": None})
                except Exception as e:  # the summary names the file and goes on
                    yield pd.DataFrame({"path": [path], "format": [kind], "first": [0], "last": [0], "error": [_error(e)]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, f, m = None, None, None
        for batch in batches:
            for path, kind, a, b, error in batch.itertuples(index=False):
                try:
                    if error:
                        raise ValueError(error)
                    if opened != path:
                        opened = None
                        if f is not None:
                            f.__exit__(None, None, None)
                            f = None
                        f = opener(local(path)).__enter__()
                        m, opened = Matrix(f, kind, size), path
                    yield m.block(a, b).assign(path=path, error=None)[["path", "cell", "gene", "value", "error"]]
                except Exception as e:
                    yield pd.DataFrame({"path": [path], "cell": [None], "gene": [None], "value": [None], "error": [error or _error(e)]})
        if f is not None:
            f.__exit__(None, None, None)

    ws = Workspace(spark, "hdf5")
    one_each = _dealt(files.select("path", "format"), tasks)
    slices = ws.save(one_each.mapInPandas(plan, "path string, format string, first long, last long, error string"), "slices")
    n = min(slices.count(), tasks or 8 * spark.sparkContext.defaultParallelism)
    # Neighbouring slices of a file go to one task, which opens the file once for them.
    dealt = slices.repartitionByRange(max(1, n), "path", "first").sortWithinPartitions(F.col("path"), F.col("first"))
    return dealt.mapInPandas(read, "path string, cell string, gene string, value double, error string")
