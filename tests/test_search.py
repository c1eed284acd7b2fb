"""Breadth-first search: unit graphs, both plans, and random graphs against plain Python."""

from __future__ import annotations

import math
from collections import deque
from pathlib import Path

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import checks, search
from latticework.plans import catalogue, derived
from latticework.sources import rmat

DATA = Path("/root/testdata/sf0.001")
PATH = [(i, i + 1) for i in range(4)]
DIAMOND = [(0, 1), (0, 2), (1, 3), (2, 3)]
LATE = [(0, 5), (5, 6), (6, 1), (1, 5)]


def table(spark: SparkSession, pairs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def plain(pairs: list[tuple[int, int]], root: int) -> dict[int, tuple[int, int]]:
    out: dict[int, list[int]] = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    found, ring = {root: (0, root)}, deque([root])
    while ring:
        new: dict[int, int] = {}
        for a in ring:
            for b in out.get(a, []):
                if b not in found:
                    new[b] = min(new.get(b, a), a)
        level = found[ring[0]][0] + 1
        found |= {v: (level, p) for v, p in new.items()}
        ring = deque(new)
    return found


def as_dict(df: DataFrame) -> dict[int, tuple[int, int]]:
    return {r["vertex"]: (r["level"], r["parent"]) for r in df.collect()}


@pytest.mark.parametrize("deep", [False, True])
@pytest.mark.parametrize(
    ("pairs", "root"), [(PATH, 0), (PATH, 4), (DIAMOND, 0), (LATE, 0), ([(7, 7), (0, 1)], 7), ([(0, 1), (1, 0), (2, 3), (3, 2)], 2), ([], 5)]
)
def test_unit_graphs(spark: SparkSession, pairs: list[tuple[int, int]], root: int, deep: bool) -> None:
    run = search.bfs_deep if deep else search.bfs
    assert as_dict(run(table(spark, pairs), [root])) == plain(pairs, root)


def test_rounds_count_the_empty_one(spark: SparkSession) -> None:
    rounds = search.bfs_rounds(table(spark, PATH), [0])
    assert [r["nf"] for r in sorted(rounds.collect(), key=lambda r: r["round"])] == [1, 1, 1, 1, 0]


@pytest.mark.parametrize(("scale", "factor", "nf"), [(4, 4, [9, 5, 1, 0]), (8, 4, [88, 97, 3, 0]), (12, 4, [621, 1699, 184, 2, 0])])
def test_golden_rounds(spark: SparkSession, scale: int, factor: int, nf: list[int]) -> None:
    graph = rmat.rmat(spark, scale, factor, 0)
    rounds = search.bfs_rounds(graph, [0], symmetric=True).collect()
    assert [r["nf"] for r in sorted(rounds, key=lambda r: r["round"])] == nf


def judged(pairs: list[tuple[int, int]], roots: list[int], switch_at: float | None) -> tuple[dict, dict]:
    """Levels and parents, and the rounds, of each root, by plain searches."""
    found, history = {}, {}
    for root in set(roots):
        own = plain(pairs, root)
        found |= {(root, v): x for v, x in own.items()}
        bottom_up = False
        for number in range(max(level for level, _ in own.values()) + 1):
            nf = sum(level == number + 1 for level, _ in own.values())
            history[root, number] = (nf, "bottom_up" if bottom_up else "top_down")
            bottom_up = bottom_up or switch_at is not None and nf > switch_at
    return found, history


def triples(df: DataFrame) -> dict:
    rows = df.collect()
    found = {(r["source"], r["vertex"]): (r["level"], r["parent"]) for r in rows}
    assert len(found) == len(rows)
    return found


@settings(max_examples=3, deadline=None, phases=(Phase.explicit, Phase.reuse, Phase.generate), suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    pairs=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40),
    roots=st.lists(st.integers(0, 12), min_size=1, max_size=5),
    symmetric=st.booleans(),
    switch_at=st.none() | st.integers(0, 5),
)
def test_random_graphs(spark: SparkSession, pairs: list, roots: list[int], symmetric: bool, switch_at: int | None) -> None:
    given_edges = [*pairs, *[(b, a) for a, b in pairs]] if symmetric else pairs
    want, rounds = judged(given_edges, roots, switch_at)
    graph = search.build(table(spark, given_edges), hub_degree=4)
    got = search.run(graph, roots, symmetric, switch_at)
    assert triples(got.result) == want
    assert {r[:2]: (r[2], r[3]) for r in got.rounds} == rounds
    assert all(r[4] <= r[5] for r in got.rounds)
    assert {(r["source"], r["round"]): (r["nf"], r["direction"]) for r in search.rounds_of(got.result, switch_at).collect()} == rounds
    assert triples(search.bfs_deep(table(spark, given_edges), roots, 3, symmetric)) == want


@pytest.mark.parametrize("switch_at", [None, 5.0, 20.0])
def test_many_roots_and_hubs_in_parts(spark: SparkSession, switch_at: float | None) -> None:
    graph = rmat.rmat(spark, 7, 4, 1)
    pairs = [tuple(r) for r in graph.collect()]
    most = max(sum(a == v for a, _ in pairs) for v, _ in pairs)
    built = search.build(graph, hub_degree=7, buckets=3)
    assert built.hubs is not None and built.edges.agg({"part": "max"}).first()[0] == -(-most // 7) - 1
    assert sorted((r["src"], r["dst"]) for r in built.edges.collect()) == sorted(pairs)
    # one build, several searches
    for roots in ([1, 2, 2, 5], [0]):
        assert triples(search.bfs(built, roots, True, switch_at)) == judged(pairs, roots, switch_at)[0]


@pytest.fixture
def sort_merge(spark: SparkSession):  # noqa: ANN201
    """Joins as they are planned where nothing is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scans_below_exchanges(plan: str) -> list[str]:
    """The scans that stand below an exchange, by what they read."""
    found, open_exchanges = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        open_exchanges = [d for d in open_exchanges if d < depth]
        if "FileScan" in line and open_exchanges:
            found.append("edges" if "bfs_edges" in line else "levels" if "bfs_levels" in line else line)
        if line.lstrip(" :+-").startswith("Exchange") or "BroadcastExchange" in line:
            open_exchanges.append(depth)
    return found


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("turned", [[], [0], [0, 1]])
def test_rounds_move_candidates_only(spark: SparkSession, sort_merge: None, symmetric: bool, turned: list[int]) -> None:
    """Neither edges nor what is visited is shuffled, in any direction; a bottom-up round sends the frontier's rows."""
    pairs = [(i, (i * 7) % 50) for i in range(50)]
    built = search.build(table(spark, pairs + [(b, a) for a, b in pairs]))
    own = search._Search(built, [1, 2], symmetric, 0.0, 10**6)
    own.turned = turned
    own._append(0, own.held.pop())
    made = own.found(1, 2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    below = scans_below_exchanges(plan)
    # candidates are made of edges and frontier rows, combined by task before they are dealt
    partial = plan.count("partial_bit_or(bits")
    assert plan.count("Exchange hashpartitioning") <= 1 + (len(turned) == 1) and plan.count("Bucketed: true") >= 2
    if turned == [0, 1]:  # in-edges lie with what is visited: not even candidates move
        assert "Exchange hashpartitioning" not in plan and below == ["levels"]
    else:
        assert partial >= 1
    assert "BroadcastExchange" in plan if turned else "BroadcastExchange" not in plan


def test_broadcasts_only_behind_a_check(spark: SparkSession, sort_merge: None) -> None:
    pairs = [(i, (i * 7) % 50) for i in range(50)]
    built = search.build(table(spark, pairs + [(b, a) for a, b in pairs]))
    own = search._Search(built, [1], True, 0.0, 10)
    own.turned = [0]
    own._append(0, own.held.pop())
    plans = [own.found(1, rows)._jdf.queryExecution().executedPlan().toString() for rows in (10, 11)]
    assert ["BroadcastExchange" in p for p in plans] == [True, False]
    want = judged([*pairs, *[(b, a) for a, b in pairs]], [1], 0)[0]
    assert triples(search.run(built, [1], True, 0, broadcast_rows=0).result) == want


@pytest.mark.parametrize("symmetric", [True, False])
@pytest.mark.parametrize("switch_at", [None, 1])
def test_levels_held_and_in_buckets(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, symmetric: bool, switch_at: int | None) -> None:
    """Levels in files of their own and in buckets, mixed, give the same rows and rounds."""
    monkeypatch.setattr(search, "THIN", 3)
    monkeypatch.setattr(search, "STRIDE", 2)
    pairs = [(i, i + 1) for i in range(9)] + [(9, 0), (4, 2), (0, 5)]
    given_edges = [*pairs, *[(b, a) for a, b in pairs]] if symmetric else pairs
    got = search.run(search.build(table(spark, given_edges)), [0, 3], symmetric, switch_at)
    want, rounds = judged(given_edges, [0, 3], switch_at)
    assert triples(got.result) == want and {r[:2]: (r[2], r[3]) for r in got.rounds} == rounds


def test_more_roots_than_bits(spark: SparkSession) -> None:
    pairs = [(i, (i * 5 + 1) % 90) for i in range(90)] + [(7, 70), (70, 7)]
    roots = list(range(70))
    assert triples(search.bfs(table(spark, pairs), roots)) == judged(pairs, roots, None)[0]


def test_no_roots_and_no_edges(spark: SparkSession) -> None:
    assert search.bfs(table(spark, PATH), []).collect() == []
    assert triples(search.bfs(table(spark, []), [4, 9])) == {(4, 4): (0, 4), (9, 9): (0, 9)}


def test_long_directed_path_merges_levels(spark: SparkSession) -> None:
    pairs = [(i, i + 1) for i in range(20)] + [(20, 0), (10, 3)]
    assert as_dict(search.bfs(table(spark, pairs), [0])) == plain(pairs, 0)


def test_direction_switches_once(spark: SparkSession) -> None:
    star = [(0, k) for k in range(1, 1001)]
    both = star + [(b, a) for a, b in star]
    rounds = search.bfs_rounds(table(spark, both), [0], True, search.switch_threshold(1001)).collect()
    assert [(r["nf"], r["direction"]) for r in sorted(rounds, key=lambda r: r["round"])] == [(1000, "top_down"), (0, "bottom_up")]


def test_unreached_and_visited(spark: SparkSession) -> None:
    every = search.with_unreached(search.bfs(table(spark, [(0, 1), (2, 3)]), [0]), 6, 0)
    assert as_dict(every) == {0: (0, 0), 1: (1, 0)} | {v: (-1, -1) for v in range(2, 6)}
    assert {r["vertex"] for r in search.visited_from_parent(every).where("visited").collect()} == {0, 1}


def test_validation_finds_each_fault(spark: SparkSession) -> None:
    graph = table(spark, DIAMOND)
    wrong = spark.createDataFrame(
        [(0, 0, 0, 0), (0, 1, 1, 0), (0, 2, 1, 1), (0, 3, 1, 1), (0, 9, 1, 8)], "source bigint, vertex bigint, level int, parent bigint"
    )
    assert {r["vertex"]: r["reason"] for r in checks.invalid_parents(wrong, graph).collect()} == {
        2: "no such edge", 3: "not one level up", 9: "parent not visited",
    }
    right = search.bfs(graph, [0])
    assert checks.invalid_parents(right, graph).isEmpty()
    row = checks.compare(right, right.where("vertex <> 3")).first()
    assert (row["visited_mismatch"], row["level_mismatch"], row["parent_differs"]) == (1, 0, 0)


def test_traversed_edges_by_convention(spark: SparkSession) -> None:
    both = table(spark, [(0, 1), (1, 0), (1, 2), (2, 1), (4, 5), (5, 4)])
    assert checks.edges_traversed(search.bfs(both, [0], True), both, True).first()["m"] == 2
    one_way = table(spark, PATH)
    assert checks.edges_traversed(search.bfs(one_way, [2]), one_way, False).first()["m"] == 2
    assert checks.edges_traversed(search.bfs(one_way, [4]), one_way, False).first()["m"] == 0


def test_layout_rings(spark: SparkSession) -> None:
    tree = spark.createDataFrame(
        [(9, 9, 0, 9), (9, 4, 1, 9), (9, 2, 1, 9), (9, 1, 2, 4), (9, 7, 2, 2), (9, 8, 2, 2)], "source bigint, vertex bigint, level int, parent bigint"
    )
    rows = {r["vertex"]: r for r in search.radial_layout(tree, 2.0, n=11).collect()}
    turns = {v: round(r["angle"] / (2 * math.pi), 6) for v, r in rows.items()}
    assert turns == {9: 0.0, 2: 0.0, 4: 0.5, 7: round(0.5 / 3, 6), 8: 0.5, 1: round(2.5 / 3, 6)} | {v: k / 5 for k, v in enumerate((0, 3, 5, 6, 10))}
    assert {v: round(math.hypot(r["x"], r["y"]), 6) for v, r in rows.items()} == {9: 0.0, 2: 2.0, 4: 2.0, 1: 4.0, 7: 4.0, 8: 4.0} | dict.fromkeys((0, 3, 5, 6, 10), 5.5)
    assert len(search.radial_layout(tree).collect()) == 6


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_searches_over_whole_tables(spark: SparkSession) -> None:
    run = catalogue.queries()
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem", "events")}
    customer = {r["o_orderkey"]: r["o_custkey"] for r in tables["orders"].collect()}
    bought = {(2 * customer[r["l_orderkey"]], 2 * r["l_partkey"] + 1) for r in tables["lineitem"].collect() if r["l_orderkey"] in customer}
    near: dict[int, set[int]] = {}
    for a, b in bought:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, front = {min(near): 0}, [min(near)]
    while front:
        found = {b for a in front for b in near[a]} - level.keys()
        level |= dict.fromkeys(found, level[front[0]] + 1)
        front = list(found)
    got = run["bfs_levels_distributed_g1"](spark, str(DATA)).collect()
    assert {r["vertex"]: r["level"] for r in got} == level
    assert all(r["parent"] == min([p for p in near[r["vertex"]] if level[p] == r["level"] - 1], default=r["vertex"]) for r in got)
    users: dict[int, int] = {}
    for r in tables["events"].collect():
        users[r["user_id"]] = users.get(r["user_id"], 0) + 1
    assert derived.event_steps(spark, str(DATA)).count() == sum(n - 1 for n in users.values())



@pytest.mark.parametrize("reach", [1, 2, 7, 8])
def test_deep_rounds_go_twice_through_balls_of_half_the_reach(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, reach: int) -> None:
    pairs = [(i, i + 1) for i in range(20)] + [(i + 1, i) for i in range(20)] + [(3, 9), (9, 3)]
    asked, balls = [], search.balls
    monkeypatch.setattr(search, "balls", lambda edges, hops: asked.append(hops) or balls(edges, hops))
    assert as_dict(search.bfs_deep(table(spark, pairs * 2), [0], reach, symmetric=True)) == plain(pairs, 0)
    assert asked == [(reach + 1) // 2]
    levels = {v: plain(pairs, v) for v in range(21)}
    want = {(v, w, n) for v in levels for w, (n, _) in levels[v].items() if 0 < n <= reach}
    assert {tuple(r) for r in balls(table(spark, pairs), reach).collect()} == want


def test_edges_in_parts_are_made_distinct_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    kind, calls = type(spark.range(1)), []
    plainly = kind.distinct
    monkeypatch.setattr(kind, "distinct", lambda df: calls.append(1) or plainly(df))
    pairs = [(0, i % 9) for i in range(40)]
    built = search.build(table(spark, pairs), hub_degree=4, buckets=2)
    assert len(calls) == 1 and built.hubs is not None
    assert sorted(tuple(r) for r in built.edges.select("src", "dst").collect()) == sorted(set(pairs))
    built.release()


def test_validation_moves_the_edges_once(spark: SparkSession, sort_merge: None) -> None:
    """Edges meet both levels and the tree in one pass: one shuffle of them, none sorted; repeated edges count as before."""
    pairs = [(i, (i * 7) % 50) for i in range(50)]
    both = sorted({*pairs, *[(b, a) for a, b in pairs]})
    built = search.build(table(spark, both), distinct=True)
    right = search.bfs(built, [1, 2], True)
    plan = checks.validate(right, built.edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bfs_edges") == 1 and "SortMergeJoin [src" not in plan and plan.count("ShuffledHashJoin") == 2
    assert sorted(tuple(r) for r in checks.validate(right, built.edges).collect()) == [(1, 0, 0, True), (2, 0, 0, True)]
    spoilt = right.where("vertex % 7 <> 5").withColumn("level", F.col("level") + (F.col("vertex") % 5 == 3).cast("int"))
    for given_edges in (both, both * 2):
        graph = table(spark, given_edges)
        wrong = {r["source"]: r["count"] for r in checks.invalid_parents(spoilt, graph).groupBy("source").count().collect()}
        level = {(r["source"], r["vertex"]): r["level"] for r in spoilt.collect()}
        far = {s: sum((s, a) in level and level.get((s, b), 99) > level[s, a] + 1 for a, b in given_edges) for s in (1, 2)}
        got = {r["source"]: (r["n_invalid_parents"], r["n_long_edges"]) for r in checks.validate(spoilt, graph).collect()}
        assert got == {s: (wrong[s], far[s]) for s in (1, 2)}


def test_built_edges_are_counted_where_they_lie(spark: SparkSession, sort_merge: None) -> None:
    pairs = [(0, 1), (1, 0), (1, 2), (2, 1), (4, 5), (5, 4), (2, 2)]
    built = search.build(table(spark, pairs), distinct=True)
    found = search.bfs(built, [0, 4], True)
    made = checks.edges_traversed(found, built.edges, True)
    # the result's vertices to the degrees, and their sums to the sources; no degrees
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {r["source"]: r["m"] for r in made.collect()} == {0: 3, 4: 1}


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_purchases_are_built_without_a_copy(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """The turning search of six roots takes the edges straight from their plan, which gives each once."""
    stored_ones, kind, calls = [], type(spark.range(1)), []
    plainly = kind.distinct
    monkeypatch.setattr(catalogue, "_graph", lambda name, *_: stored_ones.append(name))
    monkeypatch.setattr(kind, "distinct", lambda df: calls.append(1) or plainly(df))
    graph = catalogue._built("purchases", spark, str(DATA))
    assert len(calls) == 1 and graph.edges.count() == graph.edges.select("src", "dst").dropDuplicates().count()
    assert catalogue.queries()["bfs_direction_multi_source"](spark, str(DATA)).count() > 6 and stored_ones == []
