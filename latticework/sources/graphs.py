"""Readers of graph files: whitespace edge lists and Matrix Market coordinates.

Both give ``edges(src BIGINT, dst BIGINT)`` with zero-based ids. A Matrix Market
entry (row, column) is an edge from column to row. Lines are parsed by Spark
expressions, so parsing scales with the input splits; gzip files are one split
each and are dealt out again by ``repartition`` after the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.edges import with_global_rank

BANNER = "%%MatrixMarket"
#: What a coordinate matrix holds, its symmetries, and which of them exclude each other.
FIELDS = ("real", "complex", "integer", "pattern")
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")
IMPOSSIBLE = {("real", "hermitian"), ("pattern", "hermitian"), ("pattern", "skew-symmetric")}


@dataclass(frozen=True)
class Graph:
    """Edges and the number of vertices, which counts isolated ones."""

    edges: DataFrame
    n: int
    directed: bool = True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.repartition(spark.sparkContext.defaultParallelism) if path.endswith((".gz", ".bz2")) else lines


def _head(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, or of the first part of a folder of parts."""
    return spark.read.text(min(spark.read.text(path).inputFiles()))


def _tokens(line: str = "value") -> Column:
    return F.split(F.trim(F.regexp_replace(line, "[\\s]+", " ")), " ")


def edge_list_rows(lines: DataFrame) -> DataFrame:
    """(src, dst) of text lines ``value``: comments and blank lines dropped, further columns ignored."""
    kept = lines.where(~F.col("value").rlike("^\\s*(#|$)")).select(_tokens().alias("t"))
    return kept.select(F.get("t", F.lit(0)).try_cast("bigint").alias("src"), F.get("t", F.lit(1)).try_cast("bigint").alias("dst"))


def vertex_count(lines: DataFrame) -> DataFrame:
    """One row ``n``: the larger of a declared ``Nodes: N`` comment and the largest id plus one."""
    declared = lines.where(F.col("value").rlike("^\\s*#")).agg(
        F.max(F.regexp_extract("value", "Nodes:\\s*(\\d+)", 1).try_cast("bigint")).alias("declared")
    )
    largest = edge_list_rows(lines).agg((F.max(F.greatest("src", "dst")) + 1).alias("seen"))
    both = declared.select("declared", F.lit(1).alias("one")).join(largest.select("seen", F.lit(1).alias("one")), "one")
    return both.select(F.coalesce(F.greatest("declared", "seen"), F.lit(0)).cast("bigint").alias("n"))


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    lines = _lines(spark, path)
    return Graph(edge_list_rows(lines), vertex_count(lines).first()["n"])


def read_matrix_market(spark: SparkSession, path: str, strict: bool = False) -> Graph:
    """A coordinate file, or a folder of its parts. ``strict`` takes real matrices only and does not expand symmetric ones.

    Fields and symmetries that no coordinate matrix can have together are refused.

    Symmetric and skew-symmetric files hold one triangle; the mirror is added.
    """
    lines, head = _lines(spark, path), _head(spark, path)
    banner = head.where(F.col("value").startswith(BANNER)).first()
    words = banner["value"].lower().split() if banner else []
    if len(words) < 5 or words[1] != "matrix" or words[2] != "coordinate":
        raise ValueError(f"{path} is not a Matrix Market coordinate file")
    if words[3] not in FIELDS or words[4] not in SYMMETRIES or (words[3], words[4]) in IMPOSSIBLE:
        raise ValueError(f"{path}: no matrix is {words[3]} {words[4]}")
    if strict and words[3] != "real":
        raise ValueError(f"{path} holds {words[3]} values; real ones are wanted")
    body = lines.where(~F.col("value").rlike("^\\s*(%|$)")).select(_tokens().alias("t"))
    number = [F.get("t", F.lit(i)).try_cast("bigint") for i in range(3)]
    # the size line is the first one without a mark; it is told by its place, not by its form
    first = head.where(~F.col("value").rlike("^\\s*(%|$)")).limit(1).select(_tokens().alias("t"))
    size = first.select(number[0].alias("rows"), number[1].alias("cols"), F.concat_ws(" ", "t").alias("line")).first()
    if size is None or size["rows"] != size["cols"]:
        raise ValueError(f"{path}: the matrix must be square")
    told = body.select(number[1].alias("col"), number[0].alias("row"), (F.concat_ws(" ", "t") == size["line"]).alias("is_size"))
    entries = told.where(~F.col("is_size"))
    # an entry may read like the size line; all but one of such lines are entries
    alike = told.where("is_size").count() if words[3] != "pattern" else 1
    if alike > 1:
        entries = entries.unionByName(told.where("is_size").limit(alike - 1))
    edges = entries.select((F.col("col") - 1).alias("src"), (F.col("row") - 1).alias("dst"))
    if not strict and words[4] in ("symmetric", "skew-symmetric", "hermitian"):
        edges = edges.unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return Graph(edges, size["rows"], words[4] == "general")


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Either format, told apart by the first line."""
    first = _head(spark, path).first()
    matrix = first is not None and first["value"].startswith(BANNER)
    return read_matrix_market(spark, path) if matrix else read_edge_list(spark, path)


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """perm(old_id, new_id) of a file with the new id of vertex i in line i."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    ranked = with_global_rank(rows.where("trim(value) <> ''"), ["file", "block", "at"], "old_id")
    return ranked.select("old_id", F.trim("value").cast("bigint").alias("new_id"))
