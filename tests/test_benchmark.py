"""Whole runs: preparation, the multi-root benchmark and the command line."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.__main__ import main
from latticework.operators import checks, edges, search, telemetry
from latticework.plans import benchmark, prepare
from latticework.sources.graphs import Graph, read_graph, read_permutation


def test_benchmark_tables(spark: SparkSession) -> None:
    graph = prepare.generate(spark, 8, 4)
    made = benchmark.run_benchmark(spark, "s8", graph, k=4, direction_switch=True)
    rows = made.searches.collect()
    assert len({r["source"] for r in rows}) == 4 and all(r["correctness_ok"] for r in rows)
    assert all(r["nf_history"][-1] == 0 and sum(r["nf_history"]) + 1 == r["visited_count"] for r in rows)
    assert {r["m_convention"] for r in rows} == {benchmark.UNDIRECTED}
    row = made.summary.first()
    assert (row["num_searches"], row["num_correctness_fail"], row["nnz"]) == (4, 0, 1490)
    assert row["min_gteps"] <= row["harmonic_mean_gteps"] <= row["max_gteps"]


def test_rounds_are_measured(spark: SparkSession) -> None:
    graph = prepare.generate(spark, 7, 4)
    made = benchmark.run_benchmark(spark, "s7", graph, sources=[1, 2, 3], one_by_one=True)
    again = benchmark.run_benchmark(spark, "s7", graph, sources=[1, 2, 3])
    for tables in (made, again):
        nf: dict[int, list] = {}
        for r in sorted(tables.rounds.collect(), key=lambda r: r["round"]):
            nf.setdefault(r["source"], []).append(r["nf"])
        assert nf == {r["source"]: r["nf_history"] for r in tables.searches.collect()}
    checked = telemetry.rounds_check(made.rounds, made.searches, least=3.0).collect()
    assert len(checked) == 3 and all(r["ok"] and 0 < r["summed"] <= r["total"] for r in checked)
    slow = made.searches.withColumn("search_time_seconds", F.col("search_time_seconds") + 30)
    assert not any(r["ok"] for r in telemetry.rounds_check(made.rounds, slow).collect())


def test_many_searches_cost_a_few(spark: SparkSession) -> None:
    """64 roots share their rounds: they take less than a quarter of the time that they take one by one."""
    built = benchmark.build("s9", prepare.generate(spark, 9, 8))
    roots = benchmark.pick_sources(built, 64, 0)
    one = benchmark.run_searches(built, roots[:1], validate=False)
    many = benchmark.run_searches(built, roots, validate=False)
    assert len(many.searches) == 64
    assert sum(r[11] for r in many.searches) < 16 * one.searches[0][11]


def test_directed_graphs_count_out_edges(spark: SparkSession) -> None:
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (5, 0)], "src bigint, dst bigint")
    built = benchmark.build("d", Graph(edges, 6))
    _, row = benchmark.run_search(built, 0)
    assert (built.nnz, row[13], row[14]) == (3, 2, benchmark.DIRECTED)
    assert benchmark.pick_sources(built, 2, 0, [1, 1, 5]) == [1, 5]
    with pytest.raises(ValueError, match="outside"):
        benchmark.pick_sources(built, 2, 0, [6])


def test_validation_sees_missing_and_long(spark: SparkSession) -> None:
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src bigint, dst bigint")
    right = search.bfs(edges, [0])
    assert checks.validate(right, edges).first()["correctness_ok"]
    missing = right.where("vertex <> 2")
    assert checks.validate(missing, edges).first()["n_long_edges"] == 2
    deep = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 2, 1)], "source bigint, vertex bigint, level int, parent bigint")
    row = checks.validate(deep, edges).first()
    assert (row["n_invalid_parents"], row["n_long_edges"], row["correctness_ok"]) == (0, 1, False)


def test_command_line(spark: SparkSession, tmp_path: Path) -> None:
    main(["generate", "--scale", "6", "--edge-factor", "4", "--out", f"{tmp_path}/g"])
    graph = read_graph(spark, f"{tmp_path}/g.mtx")
    assert (graph.n, graph.edges.count()) == (64, 330)
    main(["balance", f"{tmp_path}/g.mtx", "--grid", "5", "--out", f"{tmp_path}/b"])
    balanced = read_graph(spark, f"{tmp_path}/b.mtx")
    assert (balanced.n, balanced.edges.count()) == (65, 330)
    for _ in range(2):
        main(["benchmark", f"{tmp_path}/b.mtx", "--searches", "2", "--out", f"{tmp_path}/r"])
    assert spark.read.parquet(f"{tmp_path}/r/searches").where("correctness_ok").count() == 4
    assert spark.read.parquet(f"{tmp_path}/r/summary").count() == 2
    main(["search", f"{tmp_path}/b.mtx", "--source", "3", "--permutation", f"{tmp_path}/b.operm", "--direction-switch", "--out", f"{tmp_path}/s"])
    row = spark.read.parquet(f"{tmp_path}/s/searches").first()
    new = next(r["new_id"] for r in read_permutation(spark, f"{tmp_path}/b.operm").collect() if r["old_id"] == 3)
    assert row["source"] == new and row["correctness_ok"]
    tree = spark.read.parquet(f"{tmp_path}/s/tree-{new}")
    assert tree.count() == row["visited_count"]
    # under old ids it is the tree of the graph before, but for which of equal parents is the least
    before = {r["vertex"]: r["level"] for r in search.bfs(graph.edges, [3], True).collect()}
    assert {r["vertex"]: r["level"] for r in tree.collect()} == before and {r["source"] for r in tree.collect()} == {3}
    assert checks.invalid_parents(tree, edges.dedup_edges(graph.edges)).isEmpty()
    assert spark.read.parquet(f"{tmp_path}/s/rounds").count() == row["rounds_completed"]
    with pytest.raises(ValueError, match="outside"):
        main(["search", f"{tmp_path}/b.mtx", "--source", "900", "--out", f"{tmp_path}/s"])


def test_graphs_with_impossible_ids_are_refused(spark: SparkSession) -> None:
    for pairs, n in (([(0, -1)], 3), ([(3, 0)], 3), ([(None, 0)], 3), ([], 0)):
        with pytest.raises(ValueError, match="outside|at least one"):
            benchmark.build("x", Graph(spark.createDataFrame(pairs, "src bigint, dst bigint"), n))
