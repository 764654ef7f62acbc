"""What the library needs of a session: a folder all executors share, and its own modules on workers."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share.

    Only where the session names none and runs on this machine alone, a folder of its own is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="bytelode-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Files:
    """Names below one folder of whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, root: str):
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._root = self._of(root)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._of(self._root, name) if name else self._root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def delete_at_exit(self) -> None:
        """Makes the folder; it goes with the driver."""
        self._fs.mkdirs(self._root)
        self._fs.deleteOnExit(self._root)

    def touch(self, name: str) -> None:
        """Makes a folder; its name is all it says."""
        self._fs.mkdirs(self._at(name))


_scopes: list[list[Scratch]] = []


class Scratch:
    """Tables that cut lineage: written once to the shared folder and read from there.

    A lost executor costs only the tasks that were running; what is written stays. What nobody has
    dropped before goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/bytelode-{uuid.uuid4().hex}"
        self.files = Files(spark, self.root)
        self.files.delete_at_exit()
        self.count = 0
        for scope in _scopes:
            scope.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.option("compression", "zstd").parquet(f"{self.root}/{self.count}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.count}")
        out._bytelode_name = str(self.count)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no later plan reads."""
        for df in tables:
            self.files.delete(df._bytelode_name)

    def clear(self) -> None:
        """Removes all tables, once the results that are read from them are written."""
        self.files.delete()


@contextmanager
def cleared() -> Iterator[None]:
    """Clears every Scratch that is made within, at the end: by then results must be written elsewhere."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for scratch in made:
            scratch.clear()


#: Bytes of a batch that a Python worker is sent, unless the session says otherwise: with Spark's 64 MB, or 10,000 rows, a worker
#: held more the larger the table's partitions were, several times over as texts, copies and results.
BATCH_BYTES, SPARKS_BYTES = 4 << 20, 64 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once; a session's own setting stays."""
    if spark.conf.get(_BATCH, None) in (None, f"{SPARKS_BYTES}b", "64MB", "64m"):
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, unless they find it by PYTHONPATH or the working folder, and sends them small batches."""
    small_batches(spark)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    there = [os.path.abspath(p) for p in (os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p] + [os.getcwd()]
    application = spark.sparkContext.applicationId
    if any(os.path.realpath(p) == os.path.realpath(root) or os.path.isdir(os.path.join(p, "bytelode")) for p in there) or application in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="bytelode-")
    archive = shutil.make_archive(os.path.join(folder, "bytelode"), "zip", root, "bytelode")
    path = list(sys.path)
    spark.sparkContext.addPyFile(archive)
    sys.path[:] = path  # the driver keeps its own copy
    _shipped.add(application)
