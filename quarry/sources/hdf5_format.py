"""The parts of the HDF5 file format that matrices are stored in, read by byte ranges.

A file is opened over anything that gives bytes at an offset, so a task reads the chunks it needs and nothing else, from a mounted
folder or from any store that Arrow's file systems reach. Groups and datasets behave like h5py's as far as matrices need: keys, attributes,
``shape`` and slices of the first dimension.

Read are superblocks 0 to 3, object headers of both kinds, groups with symbol tables or link messages, compact, contiguous and
chunked data (version 1 B-trees; single chunks, implicit indexes and fixed arrays of the newer layout), the filters deflate,
shuffle, Fletcher checksum (not verified) and LZF, integers, floats, enumerations, and texts of fixed or variable length. What is not read (links or
attributes in fractal heaps, extensible arrays, version 2 B-trees, compound types, other filters) is an error that names it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property
from typing import Any

import numpy as np

MAGIC = b"\x89HDF\r\n\x1a\n"
_PAGE = 1 << 16


class FormatError(ValueError):
    """A file that is no HDF5 file, or holds what isn't read."""


def need(ok: object, what: str) -> None:
    if not ok:
        raise FormatError(what)


class Ranges:
    """Bytes of a file; small reads go through pages, of which the last ones are kept."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.pages: dict[int, bytes] = {}

    def read(self, at: int, n: int) -> bytes:
        need(0 <= at and at + n <= self.size, f"the file ends before byte {at + n}")
        if n > _PAGE:
            return self.file.read_at(n, at)
        first, last = at // _PAGE, (at + n - 1) // _PAGE if n else at // _PAGE
        out = b"".join(self._page(i) for i in range(first, last + 1))
        return out[at - first * _PAGE :][:n]

    def _page(self, i: int) -> bytes:
        if i not in self.pages:
            if len(self.pages) >= 256:
                self.pages.pop(next(iter(self.pages)))
            self.pages[i] = self.file.read_at(min(_PAGE, self.size - i * _PAGE), i * _PAGE)
        return self.pages[i]

    def close(self) -> None:
        self.file.close()


class Cursor:
    """Little-endian fields of a block, one after the other."""

    def __init__(self, data: bytes, wide: int = 8, long: int = 8):
        self.data, self.at, self.wide, self.long = data, 0, wide, long

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int | None:
        x = self.uint(self.wide)
        return None if x == (1 << 8 * self.wide) - 1 else x

    def length(self) -> int:
        return self.uint(self.long)

    def take(self, n: int) -> bytes:
        need(self.at + n <= len(self.data), "a block ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def to(self, step: int) -> None:
        """On to the next multiple of ``step``."""
        self.at += -self.at % step


class File:
    def __init__(self, ranges: Any):
        self.ranges = ranges
        at = next((a for a in (0, *(512 << i for i in range(24))) if a + 96 <= ranges.size and ranges.read(a, 8) == MAGIC), None)
        need(at is not None, "no HDF5 file")
        version = ranges.read(at + 8, 1)[0]
        need(version <= 3, f"superblock version {version}")
        c = Cursor(ranges.read(at, 96 if at + 96 <= ranges.size else ranges.size - at))
        c.at = 9 if version > 1 else 13
        self.wide, self.long = c.uint(1), c.uint(1)
        c.wide, c.long = self.wide, self.long
        c.at = 12 if version > 1 else 24 if version == 0 else 28
        self.base = c.address() or 0
        for _ in range(2 if version > 1 else 3):
            c.address()
        if version < 2:
            c.address()  # the root's name
        self.heaps: dict[int, dict[int, bytes]] = {}
        self.root = self.node(c.address())

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_: object) -> None:
        self.ranges.close()

    def read(self, at: int, n: int) -> bytes:
        return self.ranges.read(self.base + at, n)

    def cursor(self, at: int, n: int) -> Cursor:
        return Cursor(self.read(at, n), self.wide, self.long)

    def __iter__(self) -> Iterator[str]:
        return iter(self.root)

    def __contains__(self, key: str) -> bool:
        return key in self.root

    def __getitem__(self, key: str) -> Any:
        return self.root[key]

    def node(self, at: int) -> Any:
        messages: dict[int, list[bytes]] = {}
        for kind, data in self._messages(at):
            messages.setdefault(kind, []).append(data)
        return Dataset(self, messages) if 0x08 in messages else Group(self, messages)

    def _messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(type, data) of an object header's messages."""
        newer = self.read(at, 4) == b"OHDR"
        if newer:
            c = self.cursor(at, 4 + 2 + 16 + 4 + 8)
            c.at = 5
            flags = c.uint(1)
            c.at += (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            size = c.uint(1 << (flags & 3))
            blocks = [(at + c.at, size)]
        else:
            c = self.cursor(at, 16)
            need(c.uint(1) == 1, "object header version")
            c.at = 8
            blocks, flags = [(at + 16, c.uint(4))], 0
        for start, size in blocks:  # continuations are added on the way
            c = self.cursor(start, size)
            head = (6 if flags & 4 else 4) if newer else 8
            while c.at + head <= size:
                kind, n = (c.uint(1), c.uint(2)) if newer else (c.uint(2), c.uint(2))
                shared = c.uint(1) & 2
                c.at += head - (4 if newer else 5)
                if c.at + n > size:
                    break
                data = c.take(n)
                if kind == 0x10:
                    d = Cursor(data, self.wide, self.long)
                    where, length = d.address(), d.length()
                    # newer blocks have a signature before and a checksum behind their messages
                    blocks.append((where + 4, length - 8) if newer else (where, length))
                elif shared and kind in (0x01, 0x03, 0x05, 0x0B, 0x0C):
                    yield kind, self._shared(kind, data)
                else:
                    yield kind, data

    def _shared(self, kind: int, data: bytes) -> bytes:
        """A message that another object's header holds, such as a named type."""
        c = Cursor(data, self.wide, self.long)
        version, how = c.uint(1), c.uint(1)
        need(how != 1 or version < 3, "messages in a shared heap")
        if version == 1:
            c.at = 8
        where = c.address()
        return next(d for k, d in self._messages(where) if k == kind)

    def heap_object(self, at: int, index: int) -> bytes:
        if at not in self.heaps:
            need(self.read(at, 4) == b"GCOL", "no global heap")
            size = self.cursor(at + 8, self.long).length()
            c, found = self.cursor(at, size), {}
            c.at = 8 + self.long
            while c.at + 8 + self.long <= size:
                i = c.uint(2)
                c.at += 6
                n = c.length()
                if i == 0:
                    break
                found[i] = c.take(n)
                c.to(8)
            if len(self.heaps) >= 64:
                self.heaps.pop(next(iter(self.heaps)))
            self.heaps[at] = found
        return self.heaps[at].get(index, b"")


class Type:
    """How an element lies in the file: a numpy type, a text of fixed length, or a reference to a heap."""

    def __init__(self, c: Cursor):
        head, bits, self.size = c.uint(1), c.uint(3), c.uint(4)
        self.kind, order = head & 15, ">" if bits & 1 else "<"
        self.dtype: np.dtype | None = None
        if self.kind == 0:
            self.dtype = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}")
        elif self.kind == 1:
            need(self.size in (2, 4, 8), f"floats of {self.size} bytes")
            self.dtype = np.dtype(f"{order}f{self.size}")
        elif self.kind == 3:
            self.dtype, self.padding = np.dtype(f"S{self.size}"), bits & 15
        elif self.kind == 8:
            self.dtype = Type(c).dtype
        elif self.kind == 9:
            need(bits & 15 == 1, "sequences of variable length")
        need(self.dtype is not None or self.kind == 9, f"elements of class {self.kind}")

    def decode(self, f: File, data: bytes, n: int) -> np.ndarray:
        if self.kind != 9:
            a = np.frombuffer(data, self.dtype, n)
            return np.char.rstrip(a, b" ") if self.kind == 3 and self.padding == 2 else a
        c, out = Cursor(data, f.wide, f.long), np.empty(n, object)
        for i in range(n):
            size, where, index = c.uint(4), c.address(), c.uint(4)
            out[i] = f.heap_object(where, index)[:size] if size and where else b""
        return out


def _shape(data: bytes, f: File) -> tuple[int, ...]:
    c = Cursor(data, f.wide, f.long)
    version, rank = c.uint(1), c.uint(1)
    c.at = 8 if version == 1 else 4
    return tuple(c.length() for _ in range(rank))


def _attributes(f: File, messages: list[bytes]) -> dict[str, Any]:
    out = {}
    for m in messages:
        c = Cursor(m, f.wide, f.long)
        version = c.uint(1)
        c.at = 2
        sizes = [c.uint(2) for _ in range(3)]
        c.at += version == 3
        parts = []
        for n in sizes:
            parts.append(c.take(n))
            if version == 1:
                c.to(8)
        try:
            kind, shape = Type(Cursor(parts[1], f.wide, f.long)), _shape(parts[2], f)
            n = int(np.prod(shape, dtype=np.int64))
            a = kind.decode(f, c.take(n * kind.size), n)
        except FormatError:  # an attribute of a type that matrices don't need
            continue
        out[parts[0].rstrip(b"\0").decode()] = a.reshape(shape) if shape else a[0]
    return out


class Node:
    def __init__(self, f: File, messages: dict[int, list[bytes]]):
        self.file, self.messages = f, messages

    @cached_property
    def attrs(self) -> dict[str, Any]:
        return _attributes(self.file, self.messages.get(0x0C, []))


class Group(Node):
    @cached_property
    def places(self) -> dict[str, int]:
        """Addresses of what the group holds, by name; soft and external links are left out."""
        f, out = self.file, {}
        for m in self.messages.get(0x11, []):
            c = Cursor(m, f.wide, f.long)
            tree, heap = c.address(), c.address()
            h = f.cursor(heap, 8 + 2 * f.long + f.wide)
            need(h.take(4) == b"HEAP", "no local heap")
            h.at = 8
            size = h.length()
            h.length()
            names = f.read(h.address(), size)
            for at in self._leaves(tree):
                s = f.cursor(at, 8)
                need(s.take(4) == b"SNOD", "no symbol table")
                s.at = 6
                n = s.uint(2)
                s = f.cursor(at + 8, n * (2 * f.wide + 24))
                for _ in range(n):
                    name, where, cached = s.uint(f.wide), s.address(), s.uint(4)
                    s.at += 20
                    if cached != 2:
                        out[names[name : names.index(b"\0", name)].decode()] = where
        for m in self.messages.get(0x06, []):
            c = Cursor(m, f.wide, f.long)
            c.at = 1
            flags = c.uint(1)
            kind = c.uint(1) if flags & 8 else 0
            c.at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
            name = c.take(c.uint(1 << (flags & 3))).decode()
            if kind == 0:
                out[name] = c.address()
        for m in self.messages.get(0x02, []):
            c = Cursor(m, f.wide, f.long)
            c.at = 1
            if c.uint(1) & 1:
                c.at += 8
            need(c.address() is None, "links in a fractal heap")
        return out

    def _leaves(self, at: int) -> Iterator[int]:
        f = self.file
        c = f.cursor(at, 8)
        need(c.take(4) == b"TREE" and c.uint(1) == 0, "no group tree")
        level, n = c.uint(1), c.uint(2)
        c = f.cursor(at + 8 + 2 * f.wide, n * (f.long + f.wide))
        for _ in range(n):
            c.length()
            child = c.address()
            yield from self._leaves(child) if level else [child]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self.places))

    def __contains__(self, key: str) -> bool:
        return key in self.places

    def __getitem__(self, key: str) -> Any:
        return self.file.node(self.places[key])

    def keys(self) -> list[str]:
        return list(self)


class Dataset(Node):
    @cached_property
    def shape(self) -> tuple[int, ...]:
        return _shape(self.messages[0x01][0], self.file)

    @cached_property
    def type(self) -> Type:
        return Type(Cursor(self.messages[0x03][0], self.file.wide, self.file.long))

    @cached_property
    def layout(self) -> tuple[str, Any]:
        """('whole', bytes or (address, size)) or ('chunks', shape of a chunk)."""
        f = self.file
        c = Cursor(self.messages[0x08][0], f.wide, f.long)
        version, kind = c.uint(1), c.uint(1)
        need(version in (3, 4), f"data layout version {version}")
        if kind == 0:
            return "whole", c.take(c.uint(2))
        if kind == 1:
            return "whole", (c.address(), c.length())
        need(kind == 2, "virtual data")
        if version == 3:
            rank, self._index, self._tree = c.uint(1), 0, c.address()
            dims = [c.uint(4) for _ in range(rank)]
        else:
            flags, rank, width = c.uint(1), c.uint(1), c.uint(1)
            dims = [c.uint(width) for _ in range(rank)]
            self._index = c.uint(1)
            need(self._index in (1, 2, 3), {4: "chunks in an extensible array", 5: "chunks in a version 2 B-tree"}.get(self._index, "chunk index"))
            self._single = (c.length(), c.uint(4)) if self._index == 1 and flags & 2 else None
            if self._index == 3:
                c.uint(1)
            self._tree = c.address()
        return "chunks", tuple(dims[:-1])

    @property
    def step(self) -> int:
        """Rows that are stored together."""
        kind, what = self.layout
        return what[0] if kind == "chunks" else 1

    @cached_property
    def filters(self) -> list[int]:
        if 0x0B not in self.messages:
            return []
        c, out = Cursor(self.messages[0x0B][0]), []
        version, n = c.uint(1), c.uint(1)
        c.at = 8 if version == 1 else 2
        for _ in range(n):
            kind = c.uint(2)
            name = c.uint(2) if version == 1 or kind >= 256 else 0
            c.uint(2)
            values = c.uint(2)
            c.take(name + (-name % 8 if version == 1 else 0))
            c.take(4 * (values + (values % 2 if version == 1 else 0)))
            need(kind in (1, 2, 3, 32000), f"filter {kind}")
            out.append(kind)
        return out

    @cached_property
    def chunks(self) -> list[tuple[tuple[int, ...], int, int, int]]:
        """(offsets, address, stored bytes, mask of left-out filters), in order of offsets."""
        f, shape = self.file, self.layout[1]
        if self._tree is None:
            return []
        if self._index == 0:
            return sorted(self._leaves(self._tree))
        plain = int(np.prod(shape, dtype=np.int64)) * self.type.size
        if self._index == 1:
            return [((0,) * len(shape), self._tree, *(self._single or (plain, 0)))]
        counts = [-(-n // s) for n, s in zip(self.shape, shape, strict=True)]
        corner = lambda i: tuple(int(x) * s for x, s in zip(np.unravel_index(i, counts), shape, strict=True))
        n = int(np.prod(counts, dtype=np.int64))
        if self._index == 2:
            return [(corner(i), self._tree + i * plain, plain, 0) for i in range(n)]
        head = f.cursor(self._tree, 8 + f.long + f.wide)
        need(head.take(4) == b"FAHD", "no fixed array")
        head.at = 5
        filtered, size, bits = head.uint(1), head.uint(1), head.uint(1)
        count, data = head.length(), head.address()
        need(count <= 1 << bits, "fixed arrays in pages")
        if data is None:
            return []
        c, out = f.cursor(data + 6 + f.wide, count * size), []
        for i in range(n):
            at = c.address()
            stored, mask = (c.uint(size - f.wide - 4), c.uint(4)) if filtered else (plain, 0)
            if at is not None:
                out.append((corner(i), at, stored, mask))
        return out

    def _leaves(self, at: int) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        f, rank = self.file, len(self.shape)
        c = f.cursor(at, 8)
        need(c.take(4) == b"TREE" and c.uint(1) == 1, "no chunk tree")
        level, n = c.uint(1), c.uint(2)
        c = f.cursor(at + 8 + 2 * f.wide, n * (16 + 8 * rank + f.wide))
        for _ in range(n):
            stored, mask = c.uint(4), c.uint(4)
            offsets = tuple(c.uint(8) for _ in range(rank))
            c.uint(8)
            child = c.address()
            if level:
                yield from self._leaves(child)
            else:
                yield offsets, child, stored, mask

    def _chunk(self, at: int, stored: int, mask: int) -> np.ndarray:
        data, shape = self.file.read(at, stored), self.layout[1]
        for i, kind in reversed(list(enumerate(self.filters))):
            if mask >> i & 1:
                continue
            if kind == 1:
                data = zlib.decompress(data)
            elif kind == 2:
                size = self.type.size
                even = len(data) // size * size
                data = np.frombuffer(data, np.uint8, even).reshape(size, -1).T.tobytes() + data[even:]
            elif kind == 3:
                data = data[:-4]
            else:
                data = lzf(data)
        n = int(np.prod(shape, dtype=np.int64))
        return self.type.decode(self.file, data[: n * self.type.size], n).reshape(shape)

    def __getitem__(self, key: slice | int | tuple) -> np.ndarray:
        if not isinstance(key, slice):
            return self[:][key]
        if not self.shape:
            return self._read(0, 1).reshape(())
        first, last, step = key.indices(self.shape[0])
        need(step == 1, "slices with a step")
        return self._read(first, max(first, last))

    def _read(self, first: int, last: int) -> np.ndarray:
        """Rows of the first dimension; what was never written is zero or empty."""
        f, size = self.file, self.type.size
        rest = self.shape[1:]
        width = int(np.prod(rest, dtype=np.int64))
        kind, where = self.layout
        n = (last - first) * width
        if kind == "whole":
            if isinstance(where, bytes):
                data = where[first * width * size : last * width * size]
            else:
                data = f.read(where[0] + first * width * size, n * size) if where[0] is not None else bytes(n * size)
            return self.type.decode(f, data, n).reshape(last - first, *rest)
        out = np.full((last - first, *rest), b"", object) if self.type.kind == 9 else np.zeros((last - first, *rest), self.type.dtype)
        for offsets, at, stored, mask in self.chunks:
            a, b = max(first, offsets[0]), min(last, offsets[0] + where[0])
            if a >= b:
                continue
            part = self._chunk(at, stored, mask)
            ends = tuple(min(o + w, n) for o, w, n in zip(offsets[1:], where[1:], rest, strict=True))
            inner = tuple(slice(0, e - o) for o, e in zip(offsets[1:], ends, strict=True))
            outer = tuple(slice(o, e) for o, e in zip(offsets[1:], ends, strict=True))
            out[(slice(a - first, b - first), *outer)] = part[(slice(a - offsets[0], b - offsets[0]), *inner)]
        return out


def lzf(data: bytes) -> bytes:
    """LZF: runs of literals, and copies of what stands up to 8 KB before."""
    out, i = bytearray(), 0
    while i < len(data):
        head = data[i]
        i += 1
        if head < 32:
            out += data[i : i + head + 1]
            i += head + 1
            continue
        n = head >> 5
        if n == 7:
            n += data[i]
            i += 1
        at = len(out) - ((head & 31) << 8) - data[i] - 1
        i += 1
        n += 2
        while n:  # a copy may run into itself
            part = out[at : at + n]
            out += part
            at, n = at + len(part), n - len(part)
    return bytes(out)


def open_file(uri: str) -> File:
    return File(Ranges(uri))

