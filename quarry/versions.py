"""Tables in versions: every write goes to a folder of its own, a commit makes it current, readers stay with the version they opened.

Commits are numbered files in ``_commits``; the highest number is current. A commit's file is created only if it isn't there yet, so of
two writers with the same number one fails and leaves the other's version alone. A write that breaks has no commit, so no reader
ever sees it. Versions that no kept commit names go with ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class CommitConflict(RuntimeError):
    """Another writer committed first; read its version and try again."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    note: str
    at: float


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}" if folder else self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _load(self, name: str) -> Version | None:
        stream = self._fs.open(self._path(f"{self.root}/_commits/{name}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Version(**json.loads(text))
        except ValueError:  # a commit that is being written
            return None

    def history(self) -> list[Version]:
        """All commits, oldest first."""
        return [v for n in self._list("_commits") if n.endswith(".json") and (v := self._load(n))]

    def current(self) -> Version | None:
        for name in reversed([n for n in self._list("_commits") if n.endswith(".json")]):
            if v := self._load(name):
                return v
        return None

    def path(self, version: int | None = None) -> str:
        """The folder of a version, or of the current one."""
        v = self.current() if version is None else next((v for v in self.history() if v.number == version), None)
        if v is None:
            raise FileNotFoundError(f"{self.root} has no version {'at all' if version is None else version}")
        return f"{self.root}/{v.folder}"

    def write(self, make: Callable[[str], None], note: str = "", base: Version | None = None) -> Version:
        """Let ``make`` fill a new folder, then commit it on top of ``base``, the current version if none is given."""
        base = base or self.current()
        number = (base.number if base else 0) + 1
        v = Version(number, f"v{number:08}-{uuid.uuid4().hex[:12]}", note, time.time())
        make(f"{self.root}/{v.folder}")
        name = self._path(f"{self.root}/_commits/{number:08}.json")
        if self._fs.exists(name):
            raise CommitConflict(f"version {number} of {self.root} is another writer's")
        try:
            out = self._fs.create(name, False)
        except Exception as e:
            raise CommitConflict(f"version {number} of {self.root} is another writer's") from e
        out.write(json.dumps(v.__dict__).encode())
        out.close()
        return v

    def replace(self, df: DataFrame, note: str = "") -> Version:
        """A version that holds ``df`` as Parquet; it may be made from this table's current version."""
        return self.write(lambda path: df.write.parquet(path), note)

    def read(self, version: int | None = None, schema: StructType | str | None = None) -> DataFrame:
        """A version as Parquet; the DataFrame stays with it, whatever is committed later."""
        reader = self.spark.read
        return (reader.schema(schema) if schema else reader).parquet(self.path(version))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the last ``keep`` commits names, and return them; none that is being written may be there."""
        kept = {v.folder for v in self.history()[-max(1, keep) :]}
        gone = [f for f in self._list("") if f.startswith("v") and f not in kept]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/{f}"), True)
        return gone
