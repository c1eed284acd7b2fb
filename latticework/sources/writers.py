"""Writers: Matrix Market text, permutation files, and appends that guard their schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.graphs import BANNER, FIELDS


def matrix_market_lines(edges: DataFrame, n: int, value: str = "1.0", field: str = "real", symmetric: bool = False) -> DataFrame:
    """Lines of a coordinate file, headers first, then entries by row and column; ``line`` orders them.

    A ``symmetric`` file holds the lower triangle of edges that go both ways; a ``pattern`` has no values.
    """
    if field not in FIELDS or field == "complex":
        raise ValueError(f"entries of one value are real, integer or pattern, not {field}")
    spark = edges.sparkSession
    kept = edges.where("dst >= src") if symmetric else edges
    head = spark.createDataFrame(
        [(0, 0, 0, f"{BANNER} matrix coordinate {field} {'symmetric' if symmetric else 'general'}"), (0, 0, 1, f"{n} {n} {kept.count()}")],
        "row long, col long, part int, value string",
    )
    body = kept.select((F.col("dst") + 1).alias("row"), (F.col("src") + 1).alias("col"), F.lit(2).alias("part"))
    place = [F.col("row").cast("string"), F.col("col").cast("string")]
    body = body.withColumn("value", F.concat_ws(" ", *place, *([] if field == "pattern" else [F.lit(value)])))
    return head.unionByName(body).orderBy("row", "col", "part")


def write_matrix_market(edges: DataFrame, n: int, path: str, value: str = "1.0", field: str = "real", symmetric: bool = False) -> None:
    """A folder of text parts which, in order of their names, are one coordinate file; its header is in the first."""
    matrix_market_lines(edges, n, value, field, symmetric).select("value").write.text(path)


def write_permutation(perm: DataFrame, path: str) -> None:
    """The new ids in order of the old ones, one a line, in parts in order of their names."""
    perm.orderBy("old_id").select(F.col("new_id").cast("string").alias("value")).write.text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a Parquet table; refuse rows whose columns differ from the table's."""
    spark = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        have, new = spark.read.parquet(path).dtypes, rows.dtypes
        if have != new:
            raise ValueError(f"{path} has columns {have}, the rows have {new}")
    rows.write.mode("append").parquet(path)
