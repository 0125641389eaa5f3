"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; only a local session without it gets a temporary folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="engram-"))
    return path.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path class) of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: later plans begin here, and a lost executor costs the tasks it had."""
    path = f"{work_folder(df.sparkSession)}/engram/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for t in tables:
        fs, p = hadoop(t.sparkSession, t.folder)
        fs.delete(p(t.folder), True)
