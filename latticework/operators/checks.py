"""Validation of search results, and the counts that rates are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def invalid_parents(result: DataFrame, edges: DataFrame) -> DataFrame:
    """Tree edges that are wrong: (source, vertex, parent, reason).

    A parent must be visited, joined to the vertex by an edge, and one level up.
    """
    tree = result.where(F.col("vertex") != F.col("source")).select("source", "vertex", "level", "parent")
    up = result.select("source", F.col("vertex").alias("parent"), F.col("level").alias("parent_level"))
    pairs = tree.select("parent", "vertex").distinct()
    # only edges that are tree edges of some search are kept, before anything is made distinct
    real = edges.select(F.col("src").alias("parent"), F.col("dst").alias("vertex")).join(pairs, ["parent", "vertex"], "left_semi")
    real = real.distinct().withColumn("there", F.lit(True))
    judged = tree.join(up, ["source", "parent"], "left").join(real, ["parent", "vertex"], "left")
    reason = (
        F.when(F.col("parent_level").isNull(), "parent not visited")
        .when(F.col("there").isNull(), "no such edge")
        .when(F.col("parent_level") != F.col("level") - 1, "not one level up")
    )
    return judged.withColumn("reason", reason).where("reason IS NOT NULL").select("source", "vertex", "parent", "reason")


def validate(result: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, n_invalid_parents, n_long_edges, correctness_ok) per source, without a second search.

    Valid parents show that no level is too low to be reached; that no edge leaves
    a visited vertex for one more than a level further, or not visited, shows that
    none is too high and none is missing.

    One pass over the edges tells both: they meet the level of their src where they lie, if in buckets by
    src, and are shuffled once, to the level and parent of their dst. Levels are hashed; no edge is sorted.
    """
    level = result.select("source", F.col("vertex").alias("src"), F.col("level").alias("from"))
    reached = result.select("source", F.col("vertex").alias("dst"), F.col("level").alias("to"), "parent")
    spans = edges.select("src", "dst").join(level.hint("shuffle_hash"), "src").join(reached.hint("shuffle_hash"), ["source", "dst"], "left")
    long = F.count_if(F.col("to").isNull() | (F.col("to") > F.col("from") + 1)).alias("n_long")
    # the edge of the tree, which may be there more than once
    held = F.max((F.col("src") == F.col("parent")) & (F.col("dst") != F.col("source")) & (F.col("from") == F.col("to") - 1)).alias("held")
    by_vertex = spans.groupBy("source", "dst").agg(long, held)
    met = by_vertex.groupBy("source").agg(F.sum("n_long").alias("n_long"), F.count_if("held").alias("n_held"))
    every = result.groupBy("source").agg(F.count_if(F.col("vertex") != F.col("source")).alias("n_tree")).join(met, "source", "left")
    wrong, far = F.col("n_tree") - F.coalesce("n_held", F.lit(0)), F.coalesce("n_long", F.lit(0))
    counts = every.select("source", wrong.cast("bigint").alias("n_invalid_parents"), far.cast("bigint").alias("n_long_edges"))
    return counts.withColumn("correctness_ok", (F.col("n_invalid_parents") == 0) & (F.col("n_long_edges") == 0))


def first_invalid_parents(result: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    return invalid_parents(result, edges).orderBy("source", "vertex").limit(k)


def compare(ours: DataFrame, other: DataFrame) -> DataFrame:
    """One row per source: vertices on either side, and how many differ in being visited, in level, in parent."""
    a = ours.select("source", "vertex", F.col("level").alias("la"), F.col("parent").alias("pa"))
    b = other.select("source", "vertex", F.col("level").alias("lb"), F.col("parent").alias("pb"))
    both = a.join(b, ["source", "vertex"], "full")
    return both.groupBy("source").agg(
        F.count("*").alias("n_vertices"),
        F.count_if(F.col("la").isNull() | F.col("lb").isNull()).alias("visited_mismatch"),
        F.count_if(F.col("la") != F.col("lb")).alias("level_mismatch"),
        F.count_if(F.col("pa") != F.col("pb")).alias("parent_differs"),
    )


def edges_traversed(result: DataFrame, edges: DataFrame, symmetric: bool) -> DataFrame:
    """(source, m): edges met by each search.

    On a symmetric graph an undirected edge counts once, at its larger end, as the row
    whose src that is; on a directed one all out-edges of visited vertices count. So
    edges in buckets by src are counted where they lie.
    """
    counted = edges.where("dst <= src") if symmetric else edges
    degree = counted.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("n"))
    return result.select("source", "vertex").join(degree, "vertex", "left").groupBy("source").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("m"))


def eccentricity(result: DataFrame) -> DataFrame:
    """(source, eccentricity, rounds, visited)."""
    return result.groupBy("source").agg(
        F.max("level").alias("eccentricity"), (F.max("level") + 1).alias("rounds"), F.count("*").alias("visited")
    )


def depth_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("source", "level").agg(F.count("*").alias("n_vertices"))
