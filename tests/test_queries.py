"""Every registered query of the graph engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

from latticework.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = ("orders", "lineitem", "events", "pages")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def _plain(value: object) -> tuple:
    if isinstance(value, float):
        value = None if math.isnan(value) else round(value, 6)
    if isinstance(value, int | float) and not isinstance(value, bool):
        return (1, value, "")
    return (0, 0, str(value)) if value is None else (2, 0, str(value))


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    ours = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(ours.columns)
    theirs = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(theirs.columns) == columns
    left = sorted([_plain(r[c]) for c in columns] for r in ours.collect())
    right = sorted([_plain(v.item() if hasattr(v, "item") else v) for v in row] for row in theirs[columns].astype(object).where(theirs[columns].notna(), None).itertuples(index=False))
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark: SparkSession, name: str) -> None:
    assert catalogue.queries()[name](spark, str(DATA)).count() > 0


def test_entry_points() -> None:
    import __spark_entry__

    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
