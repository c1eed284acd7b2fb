"""Adjacency that can be looked up: sorted edges in segments with offsets, by ranges of vertices.

Edges are ranked by (src, dst) and cut every ``segment`` edges and at the bounds of vertex
ranges, so a hub fills several segments and no row is larger than one. A
segment is compressed: its vertices, where the neighbours of each begin, and the
neighbours. The table is partitioned by range: a lookup reads the ranges that it asks
for and no others, by partition pruning at run time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.edges import with_global_rank
from latticework.plans.tables import discard, kept_until_exit, new_path

SPAN = 1 << 16
SEGMENT = 1 << 16
_FOUND = pa.schema([("vertex", pa.int64()), ("neighbour", pa.int64())])


@dataclass
class Adjacency:
    """``segments(range, seg, vertices, starts, neighbours)`` of vertex ranges of ``span``."""

    segments: DataFrame
    span: int

    def release(self) -> None:
        discard(self.segments)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sorted edges with the vertices and the starts of their neighbours."""
    for batch in batches:
        vertices, starts = [], []
        for edges in batch["src"]:
            src = edges.values.to_numpy()
            opens = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
            vertices.append(src[opens])
            starts.append(opens.astype(np.int32))
        yield pa.RecordBatch.from_pydict({
            "range": batch["range"], "seg": batch["seg"], "vertices": pa.array(vertices, pa.list_(pa.int64())),
            "starts": pa.array(starts, pa.list_(pa.int32())), "neighbours": batch["dst"],
        })


def build_adjacency(edges: DataFrame, span: int = SPAN, segment: int = SEGMENT) -> Adjacency:
    """The distinct ``edges(src, dst)`` as segments in the shared folder."""
    spark = edges.sparkSession
    ranked = with_global_rank(edges.select("src", "dst").distinct(), [F.col("src"), F.col("dst")], "at")
    keyed = ranked.select(F.expr(f"src div {span}").alias("range"), F.expr(f"at div {segment}").alias("seg"), F.struct("src", "dst").alias("e"))
    # a segment's edges lie in one or two sort partitions: at most ``segment`` of them meet
    gathered = keyed.groupBy("range", "seg").agg(F.array_sort(F.collect_list("e")).alias("e")).select("range", "seg", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    path = new_path(spark, "adjacency")
    schema = "range bigint, seg bigint, vertices array<bigint>, starts array<int>, neighbours array<bigint>"
    gathered.mapInArrow(_packed, schema).repartition("range").write.partitionBy("range").parquet(path)
    kept_until_exit(spark, path)
    return Adjacency(spark.read.schema(schema).parquet(path), span)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for asked, vertices, starts, neighbours in zip(batch["asked"], batch["vertices"], batch["starts"], batch["neighbours"], strict=True):
            has, wanted, start, near = (x.values.to_numpy() for x in (vertices, asked, starts, neighbours))
            at = np.searchsorted(has, wanted)
            at = at[(at < len(has)) & (has[np.minimum(at, len(has) - 1)] == wanted)]
            ends = np.r_[start[1:], len(near)]
            sizes = ends[at] - start[at]
            if not len(at):
                continue
            inside = np.repeat(start[at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(has[at], sizes)), pa.array(near[inside])], schema=_FOUND)


def neighbours_of(graph: Adjacency, vertices: DataFrame) -> DataFrame:
    """(vertex, neighbour): the out-neighbours of ``vertices(vertex)``; those without any have no row, repeats count once."""
    known = vertices.where("vertex IS NOT NULL").select("vertex", F.expr(f"vertex div {graph.span}").alias("range"))
    asked = known.groupBy("range").agg(F.array_sort(F.collect_set("vertex")).alias("asked"))  # at most ``span`` ids a range
    return graph.segments.join(asked, "range").select("asked", "vertices", "starts", "neighbours").mapInArrow(_looked_up, "vertex bigint, neighbour bigint")
