"""Result logs as CSV, run metadata as JSON, and the long table of phases by element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_results(rows: DataFrame, path: str) -> None:
    """Rows of a log, appended as CSV files with a header each."""
    rows.write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A log of CSV files with headers. A file whose header differs from ``schema`` is refused, a field that does not parse is null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line of JSON; fields that ``schema`` does not name are not read."""
    return spark.read.schema(schema).json(path)


def write_phases(rows: DataFrame, keys: list[str], phases: list[str], path: str) -> None:
    """One row (keys, phase, cycles) per phase column, as a Parquet table in folders by phase."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("cycles")) for p in phases])).alias("p")
    rows.select(*keys, each).select(*keys, "p.phase", "p.cycles").write.partitionBy("phase").parquet(path)


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_phases``; a filter on phase reads that phase's folder only."""
    return spark.read.parquet(path)
