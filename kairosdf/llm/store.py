"""The shared folder: tables and files that every executor can read.

Lineage is cut by writing a table under ``spark.checkpoint.dir``; a lost
executor then costs a re-read, not a recomputation.  Files other than tables
go through pyarrow's file systems, so the folder may be any store that
pyarrow can open.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master is local (tests), a folder of this process's own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="kairosdf-")
        spark.sparkContext.setCheckpointDir(_own["dir"])
    return _own["dir"]


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/kairosdf/{what}-{uuid.uuid4().hex[:12]}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def qualify(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        with suppress(Exception):
            p, fs = _hadoop(spark, path)
            fs.delete(p, True)


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The files right below path."""
    p, fs = _hadoop(spark, path)
    return {x.getPath().toString(): x.getLen() for x in fs.listStatus(p) if x.isFile()} if fs.exists(p) else {}


BATCH_BYTES = 8 << 20
#: seconds; writes that took longer, together, may have shuffled much
LONG_WRITE = 2
_unswept = [0.0]


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python at most BATCH_BYTES of rows at a time, however long their texts are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


_scopes: list[list[Work]] = []


@contextmanager
def written_at_once():
    """Within it, results are written out by the caller: the tables that they read go when it ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for work in _scopes.pop():
            work.drop(*list(work.paths))


class Work:
    """Tables written on the way to one result.

    drop() removes those that nothing reads any more; what the result itself
    reads goes with the scope of written_at_once() or when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}
        bounded_batches(spark)
        if _scopes:
            _scopes[-1].append(self)
        atexit.register(self._at_end)

    def table(self, what: str, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{what}")
        self._write(df.write, path)
        self.paths[what] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, what: str, df: DataFrame) -> DataFrame:
        """The table what, with df's rows added to it."""
        path = self.paths.setdefault(what, new_path(self.spark, f"{self.name}-{what}"))
        self._write(df.write.mode("append"), path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sliced(self, what: str, df: DataFrame, number: Column) -> DataFrame:
        """A table written by `slice`, a number from 0, so that slices can be read and dropped one by one."""
        df = df.withColumn("slice", number.cast("int"))
        path = self.paths[what] = new_path(self.spark, f"{self.name}-{what}")
        self._write(df.write.partitionBy("slice"), path)
        return self.spark.read.schema(df.schema).parquet(path)

    def slice(self, what: str, schema: StructType, k: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.paths[what]).where(F.col("slice") == k)

    def drop_slice(self, what: str, k: int) -> None:
        remove(self.spark, f"{self.paths[what]}/slice={k}")

    def _write(self, out: DataFrameWriter, path: str) -> None:
        began = time.monotonic()
        out.option("compression", "zstd").parquet(path)
        _unswept[0] += time.monotonic() - began
        if _unswept[0] > LONG_WRITE:
            _unswept[0] = 0.0
            # Spark removes shuffle files once the driver has collected the plan that wrote them, which an idle heap may not do for long
            self.spark._jvm.System.gc()

    def folder(self, what: str) -> str:
        self.paths[what] = new_path(self.spark, f"{self.name}-{what}")
        return self.paths[what]

    def drop(self, *whats: str) -> None:
        remove(self.spark, *(self.paths.pop(w) for w in whats if w in self.paths))

    def _at_end(self) -> None:
        with suppress(Exception):
            if self.spark.sparkContext._jsc is not None:
                self.drop(*list(self.paths))


def open_fs(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
