"""Edge-table operators on literal graphs."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import adjacency, balance, blocks, edges, search
from latticework.plans import derived
from latticework.plans.tables import stored
from latticework.sources import rmat


DATA = Path("/root/testdata/sf0.001")


def table(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def rows(df: DataFrame) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_symmetrize_drops_loops_and_repeats(spark: SparkSession) -> None:
    assert rows(edges.symmetrize(table(spark, [(0, 1), (0, 1), (1, 0), (2, 2), (3, 1)]))) == [(0, 1), (1, 0), (1, 3), (3, 1)]


def test_repeats_collapse(spark: SparkSession) -> None:
    assert rows(edges.dedup_edges(table(spark, [(0, 1)] * 3))) == [(0, 1)]


def test_symmetry_counts_repeats(spark: SparkSession) -> None:
    assert edges.is_symmetric(table(spark, [(0, 1), (1, 0), (2, 2)])).first()["is_symmetric"]
    row = edges.is_symmetric(table(spark, [(0, 1), (0, 1), (1, 0)])).first()
    assert (row["nnz"], row["asymmetric"], row["is_symmetric"]) == (3, 1, False)
    assert edges.is_symmetric(table(spark, [])).first()["is_symmetric"]


def test_symmetry_groups_one_row_per_edge(spark: SparkSession) -> None:
    rows = [(0, 1), (0, 1), (1, 0), (3, 2), (4, 4), (None, 5), (5, None), (6, None), (None, None)]
    made = edges.is_symmetric(table(spark, rows))
    assert tuple(made.first()) == (9, 3, False)
    assert "Union" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(edges.is_symmetric(table(spark, [(None, 5), (5, None), (None, None)])).first()) == (3, 0, True)


def test_self_loop_is_no_root(spark: SparkSession) -> None:
    assert rows(edges.root_candidates(table(spark, [(7, 7), (0, 1)]))) == [(0, 1)]


def test_exact_roots_follow_numpy(spark: SparkSession) -> None:
    graph = rmat.rmat(spark, 8, 4, 0)
    assert edges.sample_roots_exact(graph, 64, 0)[:8] == [186, 114, 152, 74, 180, 140, 226, 41]


@pytest.mark.parametrize(
    ("scale", "factor", "nnz", "most", "isolated"),
    [(4, 4, 68, 9, 0), (6, 4, 330, 27, 10), (8, 4, 1490, 88, 63), (10, 16, 21002, 471, 131), (12, 4, 28666, 621, 1581)],
)
def test_golden_rmat(spark: SparkSession, scale: int, factor: int, nnz: int, most: int, isolated: int) -> None:
    graph = rmat.rmat(spark, scale, factor, 0)
    row = edges.graph_stats(graph, 1 << scale).first()
    assert (row["nnz"], row["max_degree"]) == (nnz, most)
    assert (1 << scale) - edges.out_degree(graph).count() == isolated


def test_global_rank_is_gapless(spark: SparkSession) -> None:
    ranked = edges.with_global_rank(spark.range(1000).repartition(7), ["id"], "at")
    assert rows(ranked.select("id", "at")) == [(i, i) for i in range(1000)]


def test_relabel_and_balance_keep_edges(spark: SparkSession) -> None:
    graph = rmat.rmat(spark, 6, 4, 0)
    for perm in (blocks.balance_serpentine(graph, 64, 4), balance.balance_greedy(graph, 64, 4)):
        new = [r["new_id"] for r in perm.collect()]
        assert len(set(new)) == 64 and set(new) == set(range(64))
        before, after = sorted(blocks.balance_before_after(graph, perm, 64, 4).collect(), key=lambda r: r["stage"] != "before")
        assert before["nnz"] == after["nnz"] == 330
        assert after["max_nnz"] <= before["max_nnz"]


def row_by_row(pairs: list[tuple[int, int]], n: int, side: int) -> float:
    """The balance factor of placing rows one at a time, by the definition."""
    size = -(-n // side)
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    order = sorted(range(size * side), key=lambda v: (-len(near.get(v, [])), v))
    best, best_factor = {v: v for v in order}, 0.0
    while True:
        loads, free, new = [[0] * side for _ in range(side)], [size] * side, {}
        for v in order:
            band = min((b for b in range(side) if free[b]), key=lambda b: (max(loads[b]), b))
            new[v] = band * size + size - free[band]
            free[band] -= 1
            for u in near.get(v, []):
                loads[band][best[u] // size] += 1
        cells: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            cell = new[b] // size, new[a] // size
            cells[cell] = cells.get(cell, 0) + 1
        factor = len(pairs) / (side * side * max(cells.values()))
        if factor <= best_factor:
            return best_factor
        best, best_factor = new, factor


@pytest.mark.parametrize(("scale", "factor", "side"), [(10, 8, 4), (12, 8, 8)])
def test_rounds_balance_as_rows_do(spark: SparkSession, scale: int, factor: int, side: int) -> None:
    graph = stored(rmat.rmat(spark, scale, factor, 2), "test-edges")
    perm = stored(balance.balance_greedy(graph, 1 << scale, side), "test-perm")
    ids = perm.collect()
    assert sorted(r["old_id"] for r in ids) == sorted(r["new_id"] for r in ids) == list(range(1 << scale))
    got = balance.balance_factor(edges.relabel(graph, perm), 1 << scale, side)
    assert got >= 0.97 * row_by_row([tuple(r) for r in graph.collect()], 1 << scale, side)


def test_balancing_sorts_no_edges(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Edges pass a hash of the permutation; their loads give the factor that the relabelled edges have."""
    graph, n, side = stored(rmat.rmat(spark, 8, 4, 2), "test-edges"), 1 << 8, 4
    ranked = stored(edges.with_global_rank(blocks.all_degrees(graph, n), [F.col("degree").desc(), F.col("vertex")], "rank"), "test-ranks")
    perm = stored(balance.balance_greedy(graph, n, side), "test-perm")
    monkeypatch.setattr(balance, "HASHED", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        vectors = balance.load_vectors(graph, ranked, n, n // side, perm)
        plan = vectors._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    placement = balance._one_pass(stored(balance.load_vectors(graph, ranked, n, n // side, None), "test-vectors"), n, side, n // side)
    own = ranked.collect()
    ids = placement.new_ids(np.array([r["rank"] for r in own]))
    placed = spark.createDataFrame([(r["vertex"], int(i)) for r, i in zip(own, ids, strict=True)], "old_id bigint, new_id bigint")
    got = balance.placed_factor(balance.load_vectors(graph, ranked, n, n // side, placed), placement, side)
    assert got == balance.balance_factor(edges.relabel(graph, placed), n, side)


def test_levels_and_deals() -> None:
    rng = np.random.default_rng(1)
    for _ in range(50):
        side, rows = int(rng.integers(1, 7)), int(rng.integers(1, 400))
        loads, vector = rng.integers(0, 50, (side, side)), rng.integers(0, 300, side)
        room = rng.integers(0, 200, side)
        room[0] += max(0, rows - room.sum())
        taken = balance.level(loads, room, vector, rows)
        assert taken.sum() == rows and (taken >= 0).all() and (taken <= room).all()
        deal = balance.Deal(100, rows, np.cumsum(taken), np.arange(side))
        band, place = deal.placed(np.arange(100, 100 + rows))
        assert len(set(zip(band.tolist(), place.tolist(), strict=True))) == rows
        assert (np.bincount(band, minlength=side) == taken).all()
    assert balance.level(np.zeros((2, 2), np.int64), np.array([3, 3]), np.zeros(2, np.int64), 4).tolist() == [3, 1]


def test_graphs_without_edges(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert blocks.load_imbalance(none, 10, 2).first()["peak_mean_ratio"] is None
    assert sorted(r["new_id"] for r in balance.balance_greedy(none, 10, 3).collect()) == list(range(12))
    assert search.radial_layout(spark.createDataFrame([], search.RESULT)).collect() == []
    assert adjacency.neighbours_of(adjacency.build_adjacency(none), spark.createDataFrame([(1,)], "vertex bigint")).collect() == []


def test_neighbours_are_looked_up(spark: SparkSession) -> None:
    pairs = sorted({(i * i % 97, i % 83) for i in range(900)} | {(5, i) for i in range(300)})
    graph = adjacency.build_adjacency(spark.createDataFrame([*pairs, pairs[0]], "src bigint, dst bigint"), span=10, segment=16)
    wanted = spark.createDataFrame([(5,), (5,), (96,), (4,), (1000,), (None,)], "vertex bigint")
    found = adjacency.neighbours_of(graph, wanted)
    assert sorted((r["vertex"], r["neighbour"]) for r in found.collect()) == [p for p in pairs if p[0] in (4, 5, 96)]
    assert max(len(r["neighbours"]) for r in graph.segments.collect()) <= 16
    assert "dynamicpruning" in adjacency.neighbours_of(graph, stored(wanted, "test-asked").where("vertex < 50"))._jdf.queryExecution().executedPlan().toString()



def test_csr_offsets_are_prefix_sums(spark: SparkSession) -> None:
    got = rows(blocks.csr_offsets(table(spark, [(0, 1), (0, 2), (3, 1)]), 5, parts=2))
    assert got == [(0, 2, 0), (1, 0, 2), (2, 0, 2), (3, 1, 2), (4, 0, 3)]


def test_compressed_columns(spark: SparkSession) -> None:
    made = blocks.compressed_columns(table(spark, [(0, 1), (0, 0), (1, 0), (2, 3)]), 4, 2)
    assert rows(made) == [(0, 0, 0, 0, 0, 2, [0, 1]), (0, 0, 1, 1, 2, 1, [0]), (1, 1, 0, 0, 0, 1, [1])]


def test_empty_graph(spark: SparkSession) -> None:
    none = table(spark, [])
    assert rows(edges.symmetrize(none)) == rows(edges.out_degree(none)) == rows(edges.vertices_by_degree(none)) == []
    assert {r["nnz"] for r in blocks.nnz_per_block(none, 4, 2).collect()} == {0}


def test_ranks_run_on_over_ranges(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(2)
    pairs = sorted({(rng.randrange(40) // rng.choice((1, 5, 40)), rng.randrange(40)) for _ in range(300)})
    whole = [sorted(map(str, made(table(spark, pairs), 40, 2).collect())) for made in (blocks.compressed_columns, blocks.nonzero_ranks)]
    monkeypatch.setattr(blocks, "SPAN", 3)
    assert [sorted(map(str, made(table(spark, pairs), 40, 2).collect())) for made in (blocks.compressed_columns, blocks.nonzero_ranks)] == whole
    want, before = [], 0
    for v in range(40):
        n = sum(a == v for a, _ in pairs)
        want.append((v, n, before))
        before += n
    assert sorted(tuple(r) for r in blocks.csr_offsets(table(spark, pairs), 40).collect()) == want


def test_both_ways_make_rows_once(spark: SparkSession) -> None:
    """The purchases are joined and made distinct once for both directions, and no line is sorted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = table(spark, [(0, 1), (0, 1), (2, 3)])
        assert rows(derived._both_ways(one.distinct())) == [(0, 1), (1, 0), (2, 3), (3, 2)]
        if DATA.exists():
            plan = derived.purchases(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ShuffledHashJoin") == 1 and plan.count("FileScan") == 2 and "Union" not in plan and "Sort [" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
