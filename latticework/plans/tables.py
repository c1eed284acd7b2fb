"""Intermediate tables in the folder that the driver and all executors share.

Iterative plans write each round's rows there and read them back, which cuts the
lineage and lets the loss of an executor cost a re-read only. The folder is the
session's ``spark.checkpoint.dir``. What is no longer read is discarded; whatever
is left is deleted when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one in local mode only."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/latticework-tables"


def _delete(spark: SparkSession, path: str, at_exit: bool) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(where) if at_exit else store.delete(where, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path for a table of this session."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept_until_exit(spark: SparkSession, path: str) -> None:
    """Let the driver's JVM delete what was written to ``path`` when it ends."""
    _delete(spark, path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and scanned from then on."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    kept_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stored`` that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, folder, False)
