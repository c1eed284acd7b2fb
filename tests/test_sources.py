"""Readers and writers, and telemetry details that SQL does not cover."""

from __future__ import annotations

import gzip
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from latticework.operators import telemetry
from latticework.sources import graphs, writers


def _edges(graph: graphs.Graph) -> list[tuple[int, int]]:
    return sorted(map(tuple, graph.edges.collect()))


def test_edge_list_with_declared_size(spark: SparkSession, tmp_path: Path) -> None:
    text = "# Nodes: 6 Edges: 3\n\n0\t1\n 1  2 9 x\n# end\n3 0\n"
    (tmp_path / "g.txt").write_text(text)
    with gzip.open(tmp_path / "g.txt.gz", "wt") as out:
        out.write(text)
    for name in ("g.txt", "g.txt.gz"):
        graph = graphs.read_graph(spark, str(tmp_path / name))
        assert (graph.n, _edges(graph)) == (6, [(0, 1), (1, 2), (3, 0)])


def test_undeclared_size_is_largest_id(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "g.txt").write_text("0 7\n")
    assert graphs.read_edge_list(spark, str(tmp_path / "g.txt")).n == 8


def test_matrix_market_round_trip(spark: SparkSession, tmp_path: Path) -> None:
    edges = spark.createDataFrame([(0, 1), (2, 0), (1, 2)], "src bigint, dst bigint")
    writers.write_matrix_market(edges, 4, str(tmp_path / "m"))
    back = graphs.read_graph(spark, str(tmp_path / "m"))
    assert (back.n, _edges(back), back.directed) == (4, [(0, 1), (1, 2), (2, 0)], True)


def test_matrix_market_symmetry_and_strictness(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n2 1 1.5\n3 3 1.0\n3 2 2\n")
    assert _edges(graphs.read_graph(spark, str(tmp_path / "s.mtx"))) == [(0, 1), (1, 0), (1, 2), (2, 1), (2, 2)]
    assert _edges(graphs.read_matrix_market(spark, str(tmp_path / "s.mtx"), strict=True)) == [(0, 1), (1, 2), (2, 2)]
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n2 2\n")
    assert _edges(graphs.read_graph(spark, str(tmp_path / "p.mtx"))) == [(1, 0), (1, 1)]
    with pytest.raises(ValueError, match="pattern"):
        graphs.read_matrix_market(spark, str(tmp_path / "p.mtx"), strict=True)
    (tmp_path / "r.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 3 1\n1 2 1\n")
    with pytest.raises(ValueError, match="square"):
        graphs.read_graph(spark, str(tmp_path / "r.mtx"))


def test_permutation_round_trip(spark: SparkSession, tmp_path: Path) -> None:
    perm = spark.createDataFrame([(i, (7 * i) % 20) for i in range(20)], "old_id bigint, new_id bigint")
    writers.write_permutation(perm, str(tmp_path / "perm"))
    assert sorted(map(tuple, graphs.read_permutation(spark, str(tmp_path / "perm")).collect())) == [(i, (7 * i) % 20) for i in range(20)]


def test_append_guards_the_schema(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.createDataFrame([(1, 2.0)], "a int, b double")
    for _ in range(2):
        writers.append_rows(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError, match="columns"):
        writers.append_rows(rows.withColumnRenamed("b", "c"), str(tmp_path / "log"))


def test_rates_leave_out_what_is_not_finite(spark: SparkSession) -> None:
    rates = spark.createDataFrame([(2.0,), (4.0,), (0.0,), (float("nan"),), (float("inf"),), (None,)], "gteps double")
    row = telemetry.rate_summary(rates).first()
    assert (row["num_searches"], row["num_rates"], row["median_rate"]) == (6, 2, 3.0)
    assert row["harmonic_mean"] == pytest.approx(8 / 3)


def test_stopwatch_keeps_stages(spark: SparkSession) -> None:
    watch = telemetry.Stopwatch()
    watch.timed("build", lambda: None)
    with watch.stage("search"):
        pass
    assert [r["stage"] for r in watch.table(spark).collect()] == ["build", "search"]


@pytest.mark.parametrize(("field", "value", "symmetric"), [("real", "2.5", False), ("integer", "3", True), ("pattern", "", True), ("pattern", "", False)])
def test_matrix_market_of_every_kind_reads_back(spark: SparkSession, tmp_path: Path, field: str, value: str, symmetric: bool) -> None:
    pairs = [(a, b) for a in range(6) for b in range(6) if (a * b) % 4 == 1 or a == b == 2]
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint").repartition(3)
    writers.write_matrix_market(edges, 7, f"{tmp_path}/m.mtx", value, field, symmetric)
    graph = graphs.read_matrix_market(spark, f"{tmp_path}/m.mtx")
    assert (graph.n, graph.directed) == (7, not symmetric) and sorted((r["src"], r["dst"]) for r in graph.edges.collect()) == sorted(pairs)


@pytest.mark.parametrize("banner", ["real hermitian", "pattern skew-symmetric", "pattern hermitian", "quaternion general", "real odd"])
def test_impossible_matrices_are_refused(spark: SparkSession, tmp_path: Path, banner: str) -> None:
    (tmp_path / "m.mtx").write_text(f"%%MatrixMarket matrix coordinate {banner}\n2 2 1\n1 2 1.0\n")
    with pytest.raises(ValueError, match="no matrix is"):
        graphs.read_matrix_market(spark, str(tmp_path / "m.mtx"))
