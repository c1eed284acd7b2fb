"""Connected components by alternating large-star and small-star rounds.

Every round rewrites the edge list so that nodes point to smaller nodes of
their neighbourhood. Work per round is linear in the edges, neighbourhoods are
reduced by ``min`` with map-side combine (never collected), and the edge list
goes through the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.scratch import discard, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = _both_ways(edges)
    # stored, so that the join is a plain one that AQE can split where one centre has most neighbours
    least = materialize(sym.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least")), "cc-least")
    return (
        sym.where("dst > src")
        .join(least, "src")
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = materialize(down.groupBy("src").agg(F.min("dst").alias("least")), "cc-least")
    hooked = (
        down.join(least, "src")
        .where("dst <> least")
        .select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    )
    return hooked.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``.

    ``component`` is the smallest node reachable. Self-loops count as nodes,
    rows with a null end are ignored, an empty input gives an empty result.
    """
    kind = edges.schema["src"].dataType
    given = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    loops = materialize(given, "cc-given")
    current = materialize(loops.where("src <> dst"), "cc-edges")
    signature = _signature(current)
    while signature[0]:
        grown = materialize(_large_star(current), "cc-large")
        discard(current)
        current = materialize(_small_star(grown), "cc-small")
        discard(grown)
        after = _signature(current)
        if after == signature:
            break
        signature = after
    labelled = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    single = loops.where("src = dst").select(F.col("src").alias("node"), F.col("src").cast(kind).alias("component"))
    return (
        labelled.unionByName(roots).unionByName(single).groupBy("node").agg(F.min("component").alias("component"))
    )
