"""Edge-table operators. ``edges`` has src and dst BIGINT; edges run from src to dst."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.plans.tables import stored


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def check_ids(edges: DataFrame, n: int) -> None:
    """Refuse a graph without vertices, and ids that are null or outside 0 to ``n`` - 1."""
    if n <= 0:
        raise ValueError("a graph has at least one vertex")
    inside = F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)
    wrong = edges.where(~F.coalesce(inside, F.lit(False))).limit(3).collect()
    if wrong:
        raise ValueError(f"edges outside 0 to {n - 1}: {[tuple(r) for r in wrong]}")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each, without self-loops. One shuffle, combined on the map side."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return drop_self_loops(edges).select(ends.alias("e")).select("e.src", "e.dst").distinct()


def asymmetric_edges(edges: DataFrame) -> DataFrame:
    """Edges whose mirror occurs less often than they do (as multisets)."""
    signed = edges.select("src", "dst", F.lit(1).alias("one")).unionByName(reverse(edges).select("src", "dst", F.lit(-1).alias("one")))
    return signed.groupBy("src", "dst").agg(F.sum("one").alias("surplus")).where("surplus > 0").select("src", "dst", "surplus")


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row: nnz, asymmetric, is_symmetric. A single aggregation of one row per edge, instead of a self-join.

    Of an edge and its mirror, the one that occurs more often does so by the difference of the two counts.
    """
    src, dst = F.col("src"), F.col("dst")
    back = F.coalesce(src > dst, src.isNull() & dst.isNotNull())
    ahead = F.when(src.eqNullSafe(dst), 0).when(back, -1).otherwise(1)
    pairs = edges.groupBy(F.when(back, dst).otherwise(src).alias("one"), F.when(back, src).otherwise(dst).alias("other"))
    balance = pairs.agg(F.sum(ahead).alias("surplus"), F.count("*").alias("n"))
    return balance.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("nnz"),
        F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).cast("bigint").alias("asymmetric"),
    ).withColumn("is_symmetric", F.col("asymmetric") == 0)


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("degree"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """One row over the out-degrees of vertices that have any."""
    return out_degree(edges).agg(
        F.count("*").alias("n_sources"),
        F.min("degree").alias("min_degree"),
        F.max("degree").alias("max_degree"),
        F.round(F.avg("degree"), 6).alias("avg_degree"),
        F.percentile("degree", 0.5).alias("median_degree"),
    )


def graph_stats(edges: DataFrame, n: int | None = None) -> DataFrame:
    """n, nnz, avg_degree, max_degree; ``n`` counts from the largest id if not given."""
    by_source = edges.groupBy("src").agg(F.count("*").alias("degree"), F.max("dst").alias("far"))
    size = F.lit(n).cast("bigint") if n is not None else F.max(F.greatest("src", "far")) + 1
    return by_source.agg(size.alias("n"), F.sum("degree").cast("bigint").alias("nnz"), F.max("degree").alias("max_degree")).select(
        "n", "nnz", F.round(F.col("nnz") / F.col("n"), 6).alias("avg_degree"), "max_degree"
    )


def vertices_by_degree(edges: DataFrame) -> DataFrame:
    """Vertices with their rank by falling out-degree, ties by id."""
    return with_global_rank(out_degree(edges), [F.col("degree").desc(), F.col("vertex")], "position")


def with_global_rank(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with a gapless rank from 0, without a single-partition window.

    Rows are range-partitioned, sorted and written with their partition and their
    number in it; only the partitions' sizes meet in one place.
    """
    parts = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    kept = stored(parts, "ranked")
    sizes = sorted((r["_part"], r["n"], r["first"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect())
    if not sizes:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    shifts, before = [], 0
    for part, n, first in sizes:
        shifts.append((part, before - first))
        before += n
    shift = rows.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    # one row per sort partition
    return kept.join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def root_candidates(edges: DataFrame) -> DataFrame:
    """Vertices with an out-edge other than a self-loop, and the number of these."""
    return (
        edges.groupBy(F.col("src").alias("vertex"))
        .agg(F.count_if(F.col("src") != F.col("dst")).alias("degree"))
        .where("degree > 0")
    )


def sample_roots(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` candidates in order of md5(seed:vertex); a top-k, not a sort of all."""
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("vertex").cast("string")))
    return root_candidates(edges).select("vertex").orderBy(mixed, "vertex").limit(k)


def sample_roots_exact(edges: DataFrame, k: int, seed: int) -> list[int]:
    """``k`` roots as numpy's generator draws them from the ascending candidates.

    The draw needs positions only, so the candidates stay in Spark; the driver
    holds the k positions.
    """
    ranked = with_global_rank(root_candidates(edges), [F.col("vertex")], "position").select("vertex", "position")
    total = ranked.count()
    if k >= total:
        return [r["vertex"] for r in ranked.orderBy("vertex").collect()]
    at = np.random.default_rng(seed).choice(total, size=k, replace=False).tolist()
    found = {r["position"]: r["vertex"] for r in ranked.where(F.col("position").isin(at)).collect()}
    return [found[i] for i in at]


def relabel(edges: DataFrame, perm: DataFrame) -> DataFrame:
    """Edges under perm(old_id, new_id): two equi-joins, either of which AQE may broadcast by measured size."""
    p = perm.select(F.col("old_id").alias("src"), F.col("new_id").alias("new_src"))
    q = perm.select(F.col("old_id").alias("dst"), F.col("new_id").alias("new_dst"))
    return edges.join(p, "src").join(q, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"))


def translate_source(perm: DataFrame, old_id: int) -> DataFrame:
    return perm.where(F.col("old_id") == old_id).select("old_id", "new_id")


def with_old_ids(result: DataFrame, perm: DataFrame) -> DataFrame:
    """A search's (source, vertex, level, parent) on a relabelled graph, under the ids before perm(old_id, new_id)."""
    for column in ("source", "vertex", "parent"):
        names = perm.select(F.col("new_id").alias(column), F.col("old_id").alias("_old"))
        result = result.join(names, column).drop(column).withColumnRenamed("_old", column)
    return result.select("source", "vertex", "level", "parent")
