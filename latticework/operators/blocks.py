"""Two-dimensional block partitions of an edge table, their statistics, and balanced relabellings.

Block (row_b, col_b) of a grid of P x P holds the edges whose dst lies in
vertex block row_b and whose src lies in vertex block col_b.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.operators.edges import out_degree, relabel, with_global_rank


#: Vertices of a range within which ranks and prefix sums run; ranges are combined by their totals.
SPAN = 1 << 16


def block_edge(n: int, grid: int) -> int:
    return -(-n // grid)


def block_coords(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """``edges`` with row_b, col_b and the places row_l, col_l inside the block."""
    size = block_edge(n, grid)
    return edges.select(
        "src",
        "dst",
        F.expr(f"dst div {size}").alias("row_b"),
        F.expr(f"src div {size}").alias("col_b"),
        (F.col("dst") % size).alias("row_l"),
        (F.col("src") % size).alias("col_l"),
    )


def full_grid(spark: SparkSession, grid: int) -> DataFrame:
    """All blocks of the grid, from one range."""
    return spark.range(grid * grid).select(F.expr(f"id div {grid}").alias("row_b"), (F.col("id") % grid).alias("col_b"))


def nnz_per_block(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """(row_b, col_b, nnz) with zeros for empty blocks."""
    counts = block_coords(edges, n, grid).groupBy("row_b", "col_b").agg(F.count("*").alias("nnz"))
    every = full_grid(edges.sparkSession, grid)
    return every.join(counts, ["row_b", "col_b"], "left").select("row_b", "col_b", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))


def nz_lines_per_block(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """Per block with edges: nnz and its distinct nonzero columns and rows."""
    placed, block = block_coords(edges, n, grid), ["row_b", "col_b"]
    # distinct lines as sums of groups: each edge is shuffled at most twice, combined on the map side
    cols = placed.groupBy(*block, "col_l").agg(F.count("*").alias("n")).groupBy(*block).agg(F.sum("n").cast("bigint").alias("nnz"), F.count("*").alias("nz_cols"))
    rows = placed.groupBy(*block, "row_l").agg(F.count("*").alias("n")).groupBy(*block).agg(F.count("*").alias("nz_rows"))
    return cols.join(rows, block)


def partition_maxima(edges: DataFrame, n: int, grid: int) -> DataFrame:
    return nz_lines_per_block(edges, n, grid).agg(
        F.max("nnz").alias("max_nnz"), F.max("nz_cols").alias("max_nz_cols"), F.max("nz_rows").alias("max_nz_rows")
    )


def compressed_columns(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """Hypersparse columns of every block.

    Per block and nonzero column: its rank ``col_idx`` among the block's nonzero
    columns, the offset ``col_loc`` of its rows in the block, their number
    ``col_len`` and the sorted ``rows``. A column of a block has at most
    ceil(n / P) rows, so its array is bounded by the grid. Ranks and offsets run
    within ranges of columns, then over the ranges' totals: no task sorts a block.
    """
    columns = (
        block_coords(edges, n, grid)
        .groupBy("row_b", "col_b", "col_l")
        .agg(F.array_sort(F.collect_list("row_l")).alias("rows"))
        .withColumn("col_len", F.size("rows").cast("bigint"))
    )
    ranged = columns.withColumn("part", F.expr(f"col_l div {SPAN}"))
    inside = Window.partitionBy("row_b", "col_b", "part").orderBy("col_l")
    block = Window.partitionBy("row_b", "col_b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = ranged.groupBy("row_b", "col_b", "part").agg(F.count("*").alias("n"), F.sum("col_len").alias("total"))
    bases = totals.select(
        "row_b", "col_b", "part", F.coalesce(F.sum("n").over(block), F.lit(0)).alias("idx_base"), F.coalesce(F.sum("total").over(block), F.lit(0)).alias("loc_base")
    )
    local = ranged.withColumn("idx", F.row_number().over(inside) - 1).withColumn(
        "loc", F.coalesce(F.sum("col_len").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    return local.join(bases, ["row_b", "col_b", "part"]).select(
        "row_b",
        "col_b",
        "col_l",
        (F.col("idx_base") + F.col("idx")).cast("bigint").alias("col_idx"),
        (F.col("loc_base") + F.col("loc")).cast("bigint").alias("col_loc"),
        "col_len",
        "rows",
    )


def nonzero_ranks(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """Each edge's rank inside its block column, and whether it opens a new one.

    Ranks count within ranges of rows, then over the ranges' sizes, so no task sorts all edges of a hub.
    """
    column = ["row_b", "col_b", "src"]
    ranged = block_coords(edges, n, grid).withColumn("part", F.expr(f"row_l div {SPAN}"))
    inside = Window.partitionBy(*column, "part").orderBy("dst")
    before = Window.partitionBy(*column).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = ranged.groupBy(*column, "part").agg(F.count("*").alias("n"))
    bases = sizes.select(*column, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranged.withColumn("at", F.row_number().over(inside) - 1).join(bases, [*column, "part"])
    rank = (F.col("base") + F.col("at")).cast("bigint")
    return ranked.select(*column, "dst", rank.alias("rank_in_col"), (rank == 0).alias("opens_col"))


def csr_offsets(edges: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """(vertex, degree, row_start) for all vertices: prefix sums of out-degrees.

    Two-level: sums within ranges of vertices, then over the ranges' totals, so
    no window spans the whole table, and no range grows with it unless ``parts`` fixes their number.
    """
    spark = edges.sparkSession
    span = max(1, -(-n // parts)) if parts else SPAN
    degrees = spark.range(n).join(out_degree(edges), F.col("id") == F.col("vertex"), "left")
    degrees = degrees.select(F.col("id").alias("vertex"), F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"), F.expr(f"id div {span}").alias("part"))
    inside = Window.partitionBy("part").orderBy("vertex").rowsBetween(Window.unboundedPreceding, -1)
    totals = degrees.groupBy("part").agg(F.sum("degree").alias("total"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bases = totals.select("part", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"))
    local = degrees.withColumn("inside", F.coalesce(F.sum("degree").over(inside), F.lit(0)))
    return local.join(bases, "part").select("vertex", "degree", (F.col("base") + F.col("inside")).cast("bigint").alias("row_start"))


def load_imbalance(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """max and mean load, their ratio, and the balance factor nnz / (P^2 max); both null without edges."""
    loads = nnz_per_block(edges, n, grid)
    return loads.agg(F.max("nnz").alias("max_nnz"), F.avg("nnz").alias("mean"), F.sum("nnz").alias("total")).select(
        "max_nnz",
        F.round("mean", 6).alias("mean_nnz"),
        F.round(F.try_divide("max_nnz", "mean"), 6).alias("peak_mean_ratio"),
        F.round(F.try_divide("total", grid * grid * F.col("max_nnz")), 6).alias("balance_factor"),
    )


def load_summary(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """Share of empty blocks, and mean, median and maximum of the loads of the others."""
    loads = nnz_per_block(edges, n, grid)
    used = F.when(F.col("nnz") > 0, F.col("nnz"))
    return loads.agg(
        F.round(F.count_if(F.col("nnz") == 0) / F.count("*"), 6).alias("empty_share"),
        F.round(F.avg(used), 6).alias("mean_load"),
        F.percentile(used, 0.5).alias("median_load"),
        F.max("nnz").alias("max_load"),
    )


def load_histogram(edges: DataFrame, n: int, grid: int, bins: int = 60) -> DataFrame:
    """(low, high, n_blocks, percent): loads above zero in log-spaced bins with whole edges.

    Edges that round to the same number merge; the last bin is closed.
    """
    loads = nnz_per_block(edges, n, grid).where("nnz > 0")
    span = loads.agg(F.min("nnz").alias("a"), F.max("nnz").alias("b"), F.count("*").alias("n_all"))
    at = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda i: F.rint(F.pow(F.lit(10.0), F.log10("a") + (F.log10("b") - F.log10("a")) * i / bins)).cast("bigint"),
    )
    edges_of = span.select("n_all", F.array_distinct(at).alias("at"))
    bounds = edges_of.select(
        "n_all",
        F.size("at").alias("k"),
        F.posexplode(F.when(F.size("at") > 1, F.transform(F.slice("at", 1, F.size("at") - 1), lambda x, i: F.struct(x.alias("low"), F.get("at", i + 1).alias("high")))).otherwise(F.array(F.struct(F.get("at", F.lit(0)).alias("low"), F.get("at", F.lit(0)).alias("high"))))).alias("bin", "e"),
    ).select("n_all", "e.low", "e.high", (F.col("bin") >= F.col("k") - 2).alias("last"))
    counts = loads.groupBy("nnz").agg(F.count("*").alias("n"))
    # at most bins bounds: the range condition is a broadcast lookup
    inside = (counts["nnz"] >= F.col("low")) & ((counts["nnz"] < F.col("high")) | (F.col("last") & (counts["nnz"] <= F.col("high"))))
    hit = counts.join(F.broadcast(bounds), inside).groupBy("low", "high", "n_all").agg(F.sum("n").cast("bigint").alias("n_blocks"))
    return hit.select("low", "high", "n_blocks", F.round(100.0 * F.col("n_blocks") / F.col("n_all"), 6).alias("percent"))


def density_2d(edges: DataFrame, n: int, bins: int) -> DataFrame:
    """(row_bin, col_bin, n_edges) of non-empty bins."""
    n = max(1, n)
    return (
        edges.select(F.expr(f"dst * {bins} div {n}").alias("row_bin"), F.expr(f"src * {bins} div {n}").alias("col_bin"))
        .groupBy("row_bin", "col_bin")
        .agg(F.count("*").alias("n_edges"))
    )


def all_degrees(edges: DataFrame, n: int) -> DataFrame:
    """(vertex, degree): the in-edges of every vertex."""
    degrees = edges.groupBy(F.col("dst").alias("vertex")).agg(F.count("*").alias("degree"))
    every = edges.sparkSession.range(n).select(F.col("id").alias("vertex"))
    return every.join(degrees, "vertex", "left").select("vertex", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def balance_serpentine(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """perm(old_id, new_id): vertices by falling degree are dealt to the bands back and forth.

    A declarative counterpart of the greedy balancer: one sort, no state. Ids are
    padded to a multiple of the grid.
    """
    size = block_edge(n, grid)
    ranked = with_global_rank(all_degrees(edges, n), [F.col("degree").desc(), F.col("vertex")], "position")
    turn, at = F.expr(f"position div {grid}"), F.col("position") % grid
    band = F.when(turn % 2 == 0, at).otherwise(grid - 1 - at)
    return ranked.select(F.col("vertex").alias("old_id"), (band * size + turn).cast("bigint").alias("new_id"))


def balance_before_after(edges: DataFrame, perm: DataFrame, n: int, grid: int) -> DataFrame:
    """Block loads before and after a relabelling: nnz, min, max and max / max(1, min)."""
    return balance_stages({"before": edges, "after": relabel(edges, perm)}, n, grid)


def balance_stages(stages: dict[str, DataFrame], n: int, grid: int) -> DataFrame:
    """Block loads of a graph under several labellings: stage, nnz, min, max and max / max(1, min)."""
    padded = block_edge(n, grid) * grid

    def loads(of: DataFrame, label: str) -> DataFrame:
        return nnz_per_block(of, padded, grid).agg(
            F.lit(label).alias("stage"), F.sum("nnz").cast("bigint").alias("nnz"), F.min("nnz").alias("min_nnz"), F.max("nnz").alias("max_nnz")
        )

    every = reduce(DataFrame.unionByName, [loads(of, label) for label, of in stages.items()])
    return every.withColumn("ratio", F.round(F.col("max_nnz") / F.greatest("min_nnz", F.lit(1)), 6))
