"""Arrow batches in small slices, and columns of any name beside them."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that Python objects exist for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def numbered(n: int) -> list[str]:
    """The names under which ``map_columns`` hands columns over and takes them back."""
    return [f"c{i}" for i in range(n)]


def without_columns(df: DataFrame, names: Collection[str]) -> DataFrame:
    """``df`` without the columns of these names, whatever the others are called."""
    return df.select(*["`" + c.replace("`", "``") + "`" for c in df.columns if c not in names])


def map_columns(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], names: list[str], kinds: list[T.DataType]) -> DataFrame:
    """``df.mapInArrow(run)`` with the result's columns called ``names``.

    Inside, columns have numbers for names: mapInArrow looks its input up by name, where
    ``a.b`` would be the field b of a column a.
    """
    schema = T.StructType([T.StructField(n, k) for n, k in zip(numbered(len(kinds)), kinds, strict=True)])
    return df.toDF(*numbered(len(df.columns))).mapInArrow(run, schema).toDF(*names)
