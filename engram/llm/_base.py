"""Shared folder, written intermediate tables and small DataFrame helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but the ASCII white space of these code points.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of one batch between the JVM and Python while a table is written; a row of more is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of a row group: a writer holds one for each open file, a reader one for each task.
ROW_GROUP_BYTES = 16 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only where that is unset in a local session, as in tests, is a
    temporary folder made, one for each application; on a cluster it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="engram-"))
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/engram/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES, however long the texts: a batch is held on both sides, in each running task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives any executor."""
    path = work_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.work)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable) -> Callable:
    """run over batches; a worker that Spark keeps for later tasks then gives back the memory that it has freed."""

    @functools.wraps(run)
    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return out


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not at the next collection, and give it a moment.

    The listeners' queues hold the last query, and so its shuffles, until another one has ended: hence an empty one.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df has not, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text) -> "F.Column":
    """array<string> of the words of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text) -> "F.Column":
    """Number of words of a text, as a long; 0 for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")
