"""Random relabelling: a bijection of every range, its inverse, and its use as a load baseline."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.operators import blocks, scatter


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 4096])
def test_permutation_of_every_range(spark: SparkSession, n: int) -> None:
    rows = scatter.permutation(spark, n, 5).collect()
    assert sorted(r["new_id"] for r in rows) == list(range(n))
    back = scatter.permutation(spark, n, 5).select("old_id", scatter.scattered(F.col("new_id"), n, 5, inverse=True).alias("again"))
    assert all(r["old_id"] == r["again"] for r in back.collect())
    if n > 1:
        sql = f"SELECT v, {scatter.scattered_sql('v', str(n), 5)} FROM range({n}) r(v)"
        assert sorted(duckdb.sql(sql).fetchall()) == sorted(map(tuple, rows))


def test_wide_ids_and_nulls(spark: SparkSession) -> None:
    n = 2**45 + 7
    ids = [0, 1, n - 1, 2**31, 2**44 + 3, None]
    docs = spark.createDataFrame([(i,) for i in ids], "v bigint")
    there = docs.select("v", scatter.scattered(F.col("v"), n, 1).alias("to"))
    got = there.select("v", "to", scatter.scattered(F.col("to"), n, 1, inverse=True).alias("back")).collect()
    assert [r["back"] for r in got] == ids and got[-1]["to"] is None
    assert all(0 <= r["to"] < n for r in got[:-1]) and len({r["to"] for r in got}) == len(ids)


def test_random_labels_spread_a_crowded_corner_without_a_shuffle(spark: SparkSession) -> None:
    n, grid = 1 << 12, 4
    edges = spark.range(40_000).select((F.col("id") % 200).alias("src"), (F.col("id") * 7 % 199).alias("dst"))
    spread = scatter.scatter(edges, n, 3)
    assert "Exchange" not in spread._jdf.queryExecution().executedPlan().toString()
    loads = {r["stage"]: r for r in blocks.balance_stages({"before": edges, "random": spread}, n, grid).collect()}
    assert loads["before"]["max_nnz"] == 40_000 and loads["random"]["nnz"] == 40_000
    assert loads["random"]["max_nnz"] < 40_000 / grid**2 * 2 and loads["random"]["min_nnz"] > 0
    assert scatter.scatter(spread, n, 3, inverse=True).exceptAll(edges).count() == 0
    assert blocks.balance_stages({"none": edges.limit(0)}, n, grid).first()["max_nnz"] == 0


def test_rounds_run_over_batches_and_not_as_an_interpreted_fold(spark: SparkSession) -> None:
    edges = spark.range(20_000).select((F.col("id") % 9_001).alias("src"), (F.col("id") * 7 % 9_001).alias("dst"))
    spread = scatter.scatter(edges, 9_001, 3)
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    ids = dict(duckdb.sql(f"SELECT v, {scatter.scattered_sql('v', '9001', 3)} FROM range(9001) r(v)").fetchall())
    assert sorted(map(tuple, spread.collect())) == sorted((ids[i % 9_001], ids[i * 7 % 9_001]) for i in range(20_000))
    assert scatter.scatter(edges.limit(0), 9_001, 3).collect() == []
