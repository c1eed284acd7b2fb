"""Edges as a stream: incremental degrees, and first-seen edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from latticework.plans.tables import kept_until_exit, new_path, stored


def read_edge_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of ``edges(src, dst)`` from Parquet files as they arrive."""
    return spark.readStream.schema("src bigint, dst bigint").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(edges: DataFrame, event_time: str | None = None, within: str = "1 hour") -> DataFrame:
    """Each distinct edge once, when it first arrives.

    With ``event_time`` an edge is remembered until the watermark is ``within`` past it,
    so state is bounded by that span; without, by the number of distinct edges.
    """
    if event_time is None:
        return edges.dropDuplicates(["src", "dst"])
    return edges.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["src", "dst"])


def degrees(edges: DataFrame) -> DataFrame:
    """Out-degrees; in a stream, running ones with one count per vertex as state."""
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def keep_partial_degrees(edges: DataFrame, out: str) -> StreamingQuery:
    """Start a query that writes the out-degrees within each batch to ``out``; it holds no state.

    A batch's folder is named by its number and overwritten when the batch runs again, so each edge counts once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        degrees(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return edges.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()


def total_degrees(spark: SparkSession, out: str) -> DataFrame:
    """The out-degrees over all batches written so far."""
    parts = spark.read.schema("vertex bigint, degree bigint, batch bigint").parquet(out)
    return parts.groupBy("vertex").agg(F.sum("degree").cast("bigint").alias("degree"))


def replay_degrees(edges: DataFrame) -> DataFrame:
    """Out-degrees of a stored edge table, counted by streaming over its files until they are read."""
    spark = edges.sparkSession
    source = stored(edges.select("src", "dst"), "edge-stream")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    out = new_path(spark, "edge-stream-out")
    keep_partial_degrees(read_edge_stream(spark, folder, 64), out).awaitTermination()
    for path in (out, f"{out}-progress"):
        kept_until_exit(spark, path)
    return total_degrees(spark, out)
