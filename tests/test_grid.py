"""Search by cells and bitmaps: rows, odd graphs, and what a round moves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from test_search import PATH, as_dict, plain, table

from latticework.operators import grid, search
from latticework.plans.tables import stored


@pytest.mark.parametrize(("n", "side", "segment"), [(90, 4, 3), (90, 1, 1000), (70_000, 3, 50)])
def test_rows_of_the_plain_search(spark: SparkSession, n: int, side: int, segment: int) -> None:
    rng = random.Random(n)
    pairs = [(rng.randrange(n) // 7 * 7 % n, rng.randrange(n) // 11 * 11 % n) for _ in range(600)] + [(0, n - 1), (n - 1, 5), (5, 7), (7, 7)]
    cells = grid.build_cells(table(spark, [*pairs, pairs[0]]), n, side, segment)
    assert sorted((r["src"], r["dst"]) for r in cells.edges().collect()) == sorted(set(pairs))
    assert max(len(r["dst"]) for r in cells.segments.collect()) <= max(8, 4 * segment)
    want = plain(pairs, 0)
    assert as_dict(grid.bfs_grid(cells, 0)) == want
    found = grid.search_cells(cells, 0)
    sizes = [sum(level == at + 1 for level, _ in want.values()) for at in range(max(level for level, _ in want.values()) + 1)]
    assert [r[:2] for r in found.rounds] == list(enumerate(sizes))
    cells.release()


def test_small_graphs(spark: SparkSession) -> None:
    for pairs, n, root in ((PATH, 5, 0), (PATH, 5, 4), ([(0, 1), (2, 3)], 4, 2), ([], 3, 1)):
        assert as_dict(grid.bfs_grid(grid.build_cells(table(spark, pairs), n, 2), root)) == plain(pairs, root)


def test_bitmaps_hold_vertices(spark: SparkSession) -> None:
    at = [0, 1, 7, 8, 32_767, 32_768, 100_000]
    pages = grid.bitmap_pages(spark.createDataFrame([(v,) for v in at], "vertex bigint"))
    assert {r["page"] for r in pages.collect()} == {0, 1, 3}
    assert pages.agg(F.sum(F.bitmap_count("bits"))).first()[0] == len(at)
    assert sorted(r["vertex"] for r in grid.page_vertices(pages).collect()) == at


def test_a_round_moves_pages_only(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = grid.build_cells(table(spark, [(i, (i * 7) % 50) for i in range(50)]), 50, 4, buckets=4)
        state = stored(grid.bitmap_pages(spark.createDataFrame([(3,)], "vertex bigint")).select("page", F.col("bits").alias("frontier"), F.col("bits").alias("visited"), F.lit(1).cast("bigint").alias("nf")), "test-state")
        plan = grid.step(cells, state)._jdf.queryExecution().executedPlan().toString()
        cell_scan = next(line for line in plan.splitlines() if "grid_cells" in line)
        below_join = plan[plan.index("SortMergeJoin [row_b") : plan.index(cell_scan)]
        assert "Exchange" not in below_join.splitlines()[-1] and "Exchange" not in "".join(x for x in below_join.splitlines()[1:] if "Sort" not in x)
        assert "Bucketed: true" in cell_scan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_bytes(spark: SparkSession, work: DataFrame) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    last = max([s.stageId() for s in _stages(store)], default=-1)
    work.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteBytes() for s in _stages(store) if s.stageId() > last)


def _stages(store) -> list:  # noqa: ANN001
    found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [found.apply(i) for i in range(found.size())]


def test_pages_are_a_tenth_of_rows(spark: SparkSession) -> None:
    """A round with most vertices in it shuffles less than a tenth of the bytes that rows of candidates take."""
    n = 40_000
    edges = stored(spark.range(8 * n).select((F.col("id") % n).alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst")), "test-edges")
    every = spark.range(n).select(F.col("id").alias("vertex"))
    cells = grid.build_cells(edges, n, 4, buckets=4)
    rows = search.expand_topdown(edges, every.withColumn("source", F.lit(0).cast("bigint")))
    pages = grid.candidates(cells, stored(grid.bitmap_pages(every), "test-pages"))
    assert sum(r["n"] for r in pages.select(F.bitmap_count("bits").alias("n")).collect()) == rows.count()
    assert 0 < 10 * shuffled_bytes(spark, pages) < shuffled_bytes(spark, rows)


def test_cells_are_packed_from_one_shuffle(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """No shuffle makes edges distinct before they are packed; repeats meet in their segments, however many there are."""
    monkeypatch.setattr(grid, "HELD_EDGES", 10)
    kind, calls = type(spark.range(1)), []
    plainly = kind.distinct
    monkeypatch.setattr(kind, "distinct", lambda df: calls.append(1) or plainly(df))
    pairs = [(i % 60, (i * i) % 50) for i in range(3000)]
    cells = grid.build_cells(stored(table(spark, pairs), "test-edges"), 60, 3, segment=400, buckets=3)
    assert not calls and sorted((r["src"], r["dst"]) for r in cells.edges().collect()) == sorted(set(pairs))
    keys = [(r["row_b"], r["col_b"], r["page"], r["seg"]) for r in cells.segments.collect()]
    assert len(keys) == len(set(keys)) and len(keys) > 9
