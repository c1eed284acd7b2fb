"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Tables written there are read back
like any other input, so a lost executor costs a re-read and never a re-run of
the stages before, and the lineage of iterative jobs stays short. What is still
there when the driver's JVM ends is deleted.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/latticework-scratch"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let the driver's JVM delete what was written to ``path`` when it ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


#: Rows of an Arrow batch while a table is written: whole texts go to Python, so batches of Spark's 10000 are large.
ARROW_ROWS = 1000
_ARROW_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCK = threading.Lock()
_WRITING: dict[int, tuple[int, str]] = {}


@contextmanager
def _small_arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Lower the session's limit while any thread writes; the last one to end puts it back."""
    session = spark._jsparkSession.hashCode()
    with _LOCK:
        writers, before = _WRITING.get(session, (0, spark.conf.get(_ARROW_CONF)))
        _WRITING[session] = writers + 1, before
        spark.conf.set(_ARROW_CONF, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        with _LOCK:
            writers, before = _WRITING.pop(session)
            if writers > 1:
                _WRITING[session] = writers - 1, before
            else:
                spark.conf.set(_ARROW_CONF, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _small_arrow_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
