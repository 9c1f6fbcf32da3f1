"""Matrices as HDF5 files in the 10x layout, as bytes: what other tools of the field read.

Superblock 0, symbol tables, version 1 headers and B-trees: the oldest form of the format, which every reader knows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = b"\xff" * 8
_LEAF = 16  # entries of a symbol table node: twice the superblock's leaf K


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


class Writer:
    """A file that grows at its end; groups are nested mappings of arrays (numbers or byte texts) and lists of str."""

    def __init__(self, chunk: int = 1 << 15, level: int = 4, shuffle: bool = True):
        self.out, self.chunk, self.level, self.shuffle = bytearray(96), chunk, level, shuffle

    def put(self, block: bytes) -> int:
        at = len(self.out)
        self.out += _pad(block)
        return at

    def finish(self, root: Mapping) -> bytes:
        at = self.group(root)
        head = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", _LEAF // 2, 16, 0)
        head += struct.pack("<Q", 0) + _NONE + struct.pack("<Q", len(self.out)) + _NONE
        self.out[:96] = head + struct.pack("<QQII16x", 0, at, 0, 0)
        return bytes(self.out)

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(_pad(data)), 0) + _pad(data) for kind, data in messages)
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def group(self, items: Mapping) -> int:
        places = {k: self.group(v) if isinstance(v, Mapping) else self.dataset(v) for k, v in sorted(items.items())}
        names, offsets = bytearray(8), {}
        for k in places:
            offsets[k] = len(names)
            names += _pad(k.encode() + b"\0")
        heap = self.put(b"HEAP" + bytes(4) + struct.pack("<Q", len(names)) + _NONE + struct.pack("<Q", self.put(bytes(names))))
        keys, nodes = list(places), []
        for i in range(0, max(1, len(keys)), _LEAF):
            part = keys[i : i + _LEAF]
            entries = b"".join(struct.pack("<QQII16x", offsets[k], places[k], 0, 0) for k in part)
            nodes.append((self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + entries + bytes(40 * (_LEAF - len(part)))), offsets[part[-1]] if part else 0))
        tree = b"TREE" + struct.pack("<BBH", 0, 0, len(nodes)) + _NONE * 2 + struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", at, last) for at, last in nodes)
        return self.header([(0x11, struct.pack("<QQ", self.put(tree), heap))])

    def dataset(self, values: np.ndarray | list[str]) -> int:
        if isinstance(values, list):
            raw = [v.encode() for v in values]
            values = np.array(raw, dtype=f"S{max(map(len, raw), default=1) or 1}")
        size = values.dtype.itemsize
        space = struct.pack("<BBB5x", 1, values.ndim, 0) + b"".join(struct.pack("<Q", n) for n in values.shape)
        if values.dtype.kind == "S":
            kind = struct.pack("<BBBBI", 0x13, 1, 0, 0, size)
        elif values.dtype.kind == "f":
            bias, mantissa, exponent = {4: (127, 23, 8), 8: (1023, 52, 11)}[size]
            kind = struct.pack("<BBBBI", 0x11, 0x20, size * 8 - 1, 0, size) + struct.pack("<HHBBBBI", 0, size * 8, mantissa, exponent, 0, mantissa, bias)
        else:
            kind = struct.pack("<BBBBI", 0x10, 8 if values.dtype.kind == "i" else 0, 0, 0, size) + struct.pack("<HH", 0, size * 8)
        messages = [(0x01, space), (0x03, kind), (0x05, bytes([2, 2, 0, 0]))]
        if not values.size:
            return self.header([*messages, (0x08, bytes([3, 1]) + _NONE + struct.pack("<Q", 0))])
        rows = max(1, min(len(values), self.chunk // max(1, int(np.prod(values.shape[1:])))))
        chunks = []
        for a in range(0, len(values), rows):
            part = np.zeros((rows, *values.shape[1:]), values.dtype)
            part[: len(values[a : a + rows])] = values[a : a + rows]
            data = part.tobytes()
            if self.shuffle:
                data = np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()
            chunks.append((a, zlib.compress(data, self.level)))
        pipeline = b"".join([*([struct.pack("<HHHHII", 2, 0, 1, 1, size, 0)] if self.shuffle else []), struct.pack("<HHHHII", 1, 0, 1, 1, self.level, 0)])
        layout = struct.pack("<BBBQ", 3, 2, values.ndim + 1, self.tree(chunks, values.shape, rows)) + b"".join(struct.pack("<I", n) for n in (rows, *values.shape[1:], size))
        return self.header([*messages, (0x0B, bytes([1, 1 + self.shuffle]) + bytes(6) + pipeline), (0x08, layout)])

    def tree(self, chunks: list[tuple[int, bytes]], shape: tuple[int, ...], rows: int) -> int:
        """B-tree of chunks along the first dimension, of as many levels as it takes."""
        rest = struct.pack("<Q", 0) * len(shape)  # other dimensions, and the element
        key = lambda stored, at: struct.pack("<IIQ", stored, 0, at) + rest
        nodes = [(at, len(data), self.put(data)) for at, data in chunks]
        level, width = 0, 64
        while True:
            made = []
            for i in range(0, len(nodes), width):
                part = nodes[i : i + width]
                end = nodes[i + width][0] if i + width < len(nodes) else -(-shape[0] // rows) * rows
                body = b"".join(key(n, at) + struct.pack("<Q", child) for at, n, child in part) + key(0, end)
                made.append((part[0][0], part[0][1], self.put(b"TREE" + struct.pack("<BBH", 1, level, len(part)) + _NONE * 2 + body)))
            if len(made) == 1:
                return made[0][2]
            nodes, level = made, level + 1


def matrix_file(cells: list[str], genes: list[str], starts: np.ndarray, indices: np.ndarray, data: np.ndarray, chunk: int = 1 << 15) -> bytes:
    """A file of one matrix: entries of cell i are ``starts[i]`` to ``starts[i + 1]``, ``indices`` are places of genes."""
    group = {
        "barcodes": cells,
        "data": data,
        "indices": indices.astype(np.int64),
        "indptr": starts.astype(np.int64),
        "shape": np.array([len(genes), len(cells)], np.int32),
        "features": {"id": genes, "name": genes},
    }
    return Writer(chunk).finish({"matrix": group})


def write_matrices(entries: DataFrame, folder: str, name: str = "counts.h5") -> DataFrame:
    """(series_id, path, entries) after writing one file ``folder/SERIES/name`` for each series of (series_id, cell, gene, value).

    A file is written by one task, so a series has to fit one; a cell's entries of one gene are added up. The folder may be on any
    file system that Arrow reaches.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        series = rows["series_id"].iloc[0]
        cell, cells = pd.factorize(rows["cell"], sort=True)
        gene, genes = pd.factorize(rows["gene"], sort=True)
        order = np.lexsort((gene, cell))
        starts = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(cells)))])
        system, path = fs.FileSystem.from_uri(f"{folder}/{series}") if "://" in folder else (fs.LocalFileSystem(), f"{folder.removeprefix('file:')}/{series}")
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(matrix_file(list(cells), list(genes), starts, gene[order], rows["value"].to_numpy(np.float32)[order]))
        return pd.DataFrame({"series_id": [series], "path": [f"{folder}/{series}/{name}"], "entries": [len(rows)]})

    once = entries.groupBy("series_id", "cell", "gene").agg(F.sum("value").alias("value"))
    return once.groupBy("series_id").applyInPandas(run, "series_id string, path string, entries long")
