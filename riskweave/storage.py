"""Intermediate tables on the storage that driver and executors share.

The cluster names it in ``spark.checkpoint.dir``. Only where the session runs on this one machine and names none, as
in tests, a folder is made; elsewhere a missing setting is an error, since part files on the disks of single machines
would make results incomplete.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="riskweave-shared-")
        spark.conf.set(SETTING, base)
    return base


def scratch(spark: SparkSession) -> str:
    """A fresh folder there; `clear` removes it."""
    path = os.path.join(shared_folder(spark), f"riskweave-{uuid.uuid4().hex}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back: lineage ends there, lost executors lose nothing, and later plans know its size."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it does not exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []


def clear(spark: SparkSession) -> int:
    """Removes the intermediate tables of this application, once no result that reads them is needed any more."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)
