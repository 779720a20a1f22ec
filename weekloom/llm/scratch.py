"""Shared scratch space: tables written once, to cut lineage and to be read several times."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A new temporary folder is taken only where none is set and the master is local; on a cluster, executors would write to
    their own disks and later reads would miss rows, so a missing setting is an error there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is not set: with master {master}, a folder that all executors share is needed")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-weekloom-")
    return _OWN[app]


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lost executors then cost no recomputation
    beyond this point, and ids made while writing stay what they are."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weekloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
