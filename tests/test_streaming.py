"""Edges as a stream: counts without state, first sightings with and without a bound."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from latticework.streaming import edge_stream


def files(spark: SparkSession, path: str, batches: list[list[tuple]], schema: str) -> None:
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def collected(spark: SparkSession, stream: DataFrame, name: str, tmp_path: Path) -> list[tuple]:
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_degrees_go_on_where_they_stopped(spark: SparkSession, tmp_path: Path) -> None:
    pairs, source, out = [(1, 2), (1, 3), (2, 3), (1, 2)], f"{tmp_path}/edges", f"{tmp_path}/out"
    files(spark, source, [pairs, pairs[:1]], "src bigint, dst bigint")
    for _ in range(2):
        edge_stream.keep_partial_degrees(edge_stream.read_edge_stream(spark, source), out).awaitTermination()
    files(spark, source, [[(9, 1)]], "src bigint, dst bigint")
    edge_stream.keep_partial_degrees(edge_stream.read_edge_stream(spark, source), out).awaitTermination()
    assert {r["vertex"]: r["degree"] for r in edge_stream.total_degrees(spark, out).collect()} == Counter([1, 1, 2, 1, 1, 9])
    assert len(list(Path(out).glob("batch=*"))) == 3


def test_replay_counts_a_table(spark: SparkSession) -> None:
    got = edge_stream.replay_degrees(spark.createDataFrame([(i % 7, i) for i in range(100)], "src bigint, dst bigint"))
    assert {r["vertex"]: r["degree"] for r in got.collect()} == Counter(i % 7 for i in range(100))


def test_first_sightings(spark: SparkSession, tmp_path: Path) -> None:
    source = f"{tmp_path}/edges"
    files(spark, source, [[(1, 2), (1, 2)], [(1, 2), (2, 1)]], "src bigint, dst bigint")
    assert collected(spark, edge_stream.first_seen(edge_stream.read_edge_stream(spark, source)), "seen", tmp_path) == [(1, 2), (2, 1)]
    timed = f"{tmp_path}/timed"
    files(spark, timed, [[(1, 2, "2020-01-01 00:00:00"), (1, 2, "2020-01-01 00:10:00")]], "src bigint, dst bigint, at string")
    stream = spark.readStream.schema("src bigint, dst bigint, at string").parquet(timed).selectExpr("src", "dst", "timestamp(at) AS at")
    assert [r[:2] for r in collected(spark, edge_stream.first_seen(stream, "at"), "seen_timed", tmp_path)] == [(1, 2)]
