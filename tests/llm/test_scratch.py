"""Tables in the shared folder: several threads at once, and cleaning up."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import SparkSession

from latticework.llm import scratch


def test_threads_leave_the_session_as_it_was(spark: SparkSession) -> None:
    before = spark.conf.get(scratch._ARROW_CONF)
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda i: scratch.materialize(spark.range(10 * i), f"thread{i}"), range(8)))
    assert [t.count() for t in tables] == [10 * i for i in range(8)]
    assert spark.conf.get(scratch._ARROW_CONF) == before and not scratch._WRITING


def test_discarded_tables_are_gone(spark: SparkSession) -> None:
    table = scratch.materialize(spark.range(5), "gone")
    files = [Path(f.removeprefix("file://")) for f in table.inputFiles()]
    assert all(f.exists() for f in files)
    scratch.discard(table)
    assert not any(f.exists() for f in files)
