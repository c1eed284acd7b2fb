"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, max_rows: int, per_class: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id_col, y double): at most ``max_rows`` labelled ids (of each class, if ``per_class``), by hash order.

    Ids that repeat with unequal labels count by their smaller label. The result
    has a bounded number of rows, so it may be broadcast.
    """
    known = labels.select(id_col, F.col(label_col).cast("double").alias("y")).where(
        F.col(id_col).isNotNull() & F.col("y").isin(0.0, 1.0) & ~held_out(id_col)
    )
    one = known.groupBy(id_col).agg(F.min("y").alias("y"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)

    return first(one.where("y = 0")).unionByName(first(one.where("y = 1"))) if per_class else first(one)
