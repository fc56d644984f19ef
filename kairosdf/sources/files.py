"""Small files on any file system that Spark knows."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.option("wholetext", True).text(str(path)).collect()
    return "".join(r[0] for r in rows)


def write_json(spark: SparkSession, path: str, report: dict) -> None:
    write_text(spark, path, json.dumps(report, indent=2, default=str))


_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach, below spark.checkpoint.dir; where that is unset and the
    master is local, as in tests, a temporary one.  It goes when the process ends."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="kairosdf-")
            atexit.register(shutil.rmtree, _own["dir"].removeprefix("file://"), ignore_errors=True)
        where = _own["dir"]
    path = f"{where.rstrip('/')}/kairosdf-study/{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        with suppress(Exception):
            if spark.sparkContext._jsc is not None:
                p, fs = _fs(spark, path)
                fs.delete(p, True)
