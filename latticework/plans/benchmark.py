"""Whole runs: timed searches, and the multi-root benchmark with its three result tables.

Construction (reading, de-duplicating and storing the edges in buckets by source) is
timed by itself and made once; every search scans the same buckets, and its time runs
from the root to the stored result. Searches share their rounds, a bit each, so the edges
are met once for all; the time of each is then an equal share of the batch's. With
``one_by_one`` each is run and timed alone. Rounds are timed as they run, and their
times are checked against the searches'. Every search is validated, outside its time.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import checks, edges, search, telemetry
from latticework.plans.tables import discard, stored
from latticework.sources.graphs import Graph

SEARCHES = (
    "timestamp string, graph string, n bigint, nnz bigint, matrix_symmetric boolean, search_idx int, source bigint, rounds_completed int, nf_history array<bigint>, "
    "direction_history array<string>, correctness_ok boolean, search_time_seconds double, visited_count bigint, m_edges_traversed bigint, m_convention string, gteps double"
)
SUMMARY = (
    "timestamp string, graph string, n bigint, nnz bigint, matrix_symmetric boolean, num_searches bigint, num_correctness_fail bigint, "
    "construction_time_seconds double, harmonic_mean_gteps double, min_gteps double, median_gteps double, max_gteps double"
)
#: Times of a batch's round are those of the whole batch: its searches run side by side.
ROUNDS = "timestamp string, graph string, search_idx int, source bigint, round int, nf bigint, direction string, started double, ended double"
UNDIRECTED, DIRECTED = "undirected_dedup", "directed_source_visited"


@dataclass
class Built:
    """A constructed graph: stored edges, sizes and how long that took."""

    name: str
    graph: search.Built
    n: int
    nnz: int
    symmetric: bool
    seconds: float

    @property
    def edges(self) -> DataFrame:
        return self.graph.edges.select("src", "dst")


def build(name: str, graph: Graph) -> Built:
    """Distinct edges in buckets by source, which every search scans as they are."""
    began = time.perf_counter()
    edges.check_ids(graph.edges, graph.n)
    made = search.build(graph.edges)
    row = edges.is_symmetric(made.edges).first()
    return Built(name, made, graph.n, row["nnz"], row["is_symmetric"], time.perf_counter() - began)


def pick_sources(built: Built, k: int, seed: int, sources: list[int] | None = None) -> list[int]:
    """The given roots, checked, or ``k`` drawn ones with an edge other than a self-loop."""
    if sources is None:
        return edges.sample_roots_exact(built.edges, k, seed)
    wrong = [s for s in sources if not 0 <= s < built.n]
    if wrong:
        raise ValueError(f"roots outside 0 to {built.n - 1}: {wrong}")
    return list(dict.fromkeys(sources))


@dataclass
class Ran:
    """Stored results (source, vertex, level, parent) of searches, and their rows of SEARCHES and ROUNDS."""

    found: DataFrame
    searches: list[tuple]
    rounds: list[tuple]


def run_searches(built: Built, sources: list[int], first: int = 0, direction_switch: bool = False, validate: bool = True) -> Ran:
    """Searches from all ``sources`` together, numbered from ``first`` on."""
    switch_at = search.switch_threshold(built.n) if direction_switch else None
    began = time.perf_counter()
    ran = search.run(built.graph, sources, built.symmetric, switch_at)
    found = stored(ran.result, "benchmark-result")
    seconds = (time.perf_counter() - began) / max(1, len(sources))
    m = {r["source"]: r["m"] for r in checks.edges_traversed(found, built.edges, built.symmetric).collect()}
    ok = {r["source"]: r["correctness_ok"] for r in checks.validate(found, built.edges).collect()} if validate else {}
    now = datetime.now(UTC).isoformat()
    rows, rounds = [], []
    for index, source in enumerate(sources, first):
        own = [r for r in ran.rounds if r[0] == source]
        nf = [r[2] for r in own]
        rows.append((
            now, built.name, built.n, built.nnz, built.symmetric, index, source, len(nf), nf, [r[3] for r in own], ok.get(source), seconds, sum(nf) + 1, m[source],
            UNDIRECTED if built.symmetric else DIRECTED, m[source] / seconds / 1e9,
        ))
        rounds += [(now, built.name, index, *r) for r in own]
    return Ran(found, rows, rounds)


def run_search(built: Built, source: int, index: int = 0, direction_switch: bool = False, validate: bool = True) -> tuple[DataFrame, tuple]:
    """The stored result of one search, and its row of the SEARCHES table."""
    ran = run_searches(built, [source], index, direction_switch, validate)
    return ran.found, ran.searches[0]


@dataclass
class Tables:
    """The result tables of a benchmark."""

    searches: DataFrame
    summary: DataFrame
    rounds: DataFrame


def run_benchmark(
    spark: SparkSession, name: str, graph: Graph, k: int = 64, seed: int = 0, sources: list[int] | None = None, direction_switch: bool = False, validate: bool = True, one_by_one: bool = False
) -> Tables:
    """One construction, searches from all roots, and the harmonic mean of their rates."""
    built = build(name, graph)
    roots = pick_sources(built, k, seed, sources)
    batches = [[r] for r in roots] if one_by_one else [roots[i : i + search.BATCH] for i in range(0, len(roots), search.BATCH)]
    ran, at = [], 0
    for batch in batches:
        ran.append(run_searches(built, batch, at, direction_switch, validate))
        discard(ran[-1].found)
        at += len(batch)
    built.graph.release()
    rows = [r for one in ran for r in one.searches]
    searches = spark.createDataFrame(rows, SEARCHES)
    rates = telemetry.rate_summary(searches)
    failed = searches.agg(F.count_if(~F.col("correctness_ok")).alias("failed")).first()["failed"]
    r = rates.first()
    summary = (
        datetime.now(UTC).isoformat(), name, built.n, built.nnz, built.symmetric, len(rows), failed, built.seconds,
        r["harmonic_mean"], r["min_rate"], r["median_rate"], r["max_rate"],
    )
    return Tables(searches, spark.createDataFrame([summary], SUMMARY), spark.createDataFrame([r for one in ran for r in one.rounds], ROUNDS))
