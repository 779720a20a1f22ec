"""Folders for derived files: under ``spark.checkpoint.dir``, which every executor sees; a temporary one where that is unset and
the master is local. On a cluster a missing setting is an error, as executors would write to their own disks.

What a session has made stays until ``cleanup(spark)`` takes it away; results that still read from it must be written before.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def _base(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is not set: with master {master}, a folder that all executors share is needed")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-weekloom-")
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{_base(spark)}/weekloom/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once and reads it back: a cut in its lineage that lost executors don't undo."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Deletes what this session has made by ``new_folder`` and ``staged``; the number of folders that were there."""
    jvm, gone = spark.sparkContext._jvm, 0
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True))
    return gone
