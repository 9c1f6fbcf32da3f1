"""Intermediate tables in the folder that all executors share.

Multi-step operators cut their lineage by writing a table and reading it again, so that a lost executor costs a
task retry and not the whole job. The folder comes from ``spark.checkpoint.dir``; only where that is unset and the master
is local (tests, a laptop) a temporary folder of this process is used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that nothing needs installing there."""
    app = spark.sparkContext.applicationId
    if _own.get("shipped") == app:
        return
    folder = tempfile.mkdtemp(prefix="quarry-ship-")  # on the driver only; Spark serves it to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    with zipfile.ZipFile(f"{folder}/quarry-{app}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    spark.sparkContext.addPyFile(f"{folder}/quarry-{app}.zip")
    _own["shipped"] = app


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one temporary folder for this process if none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "tmp" not in _own:
        _own["tmp"] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _own["tmp"], ignore_errors=True)
    return "file://" + _own["tmp"]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that operators left in the shared folder; call it when their results have been used."""
    while _roots:
        _delete(spark, _roots.pop())


@contextmanager
def many_small_files(spark: SparkSession) -> Iterator[None]:
    """Settings for steps over many small files, put back afterwards.

    A stream of files lists each file of a batch anew, as a path of its own, and Spark makes up to 10,000 tasks of that. It also
    counts a file as 4 MB when it packs files into tasks: 32 to a task, however small they are.
    """
    settings = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": str(128 << 10)}
    former = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)


class Workspace:
    """Named Parquet tables under one folder of the shared storage."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quarry-{label}-{uuid.uuid4().hex[:12]}"
        _roots.append(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` under ``name`` and return the table as read again."""
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def put(self, name: str, text: str) -> str:
        """Write a small text file and return its path."""
        path = f"{self.root}/{name}"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(text.encode())
        out.close()
        return path

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished steps, which it ties to garbage collection."""
        gc.collect()
        self.spark._jvm.System.gc()
