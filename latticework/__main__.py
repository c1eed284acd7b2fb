"""``python -m latticework``: generate, prepare and search graphs from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from latticework.operators.edges import translate_source, with_old_ids
from latticework.plans import benchmark, prepare
from latticework.sources.graphs import read_permutation
from latticework.sources.writers import append_rows


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="latticework", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    made = commands.add_parser("generate", help="write an R-MAT graph")
    made.add_argument("--scale", type=int, required=True)
    made.add_argument("--edge-factor", type=int, default=16)
    made.add_argument("--seed", type=int, default=0)
    ready = commands.add_parser("balance", help="relabel a graph for a grid of blocks")
    ready.add_argument("graph")
    ready.add_argument("--grid", type=int, required=True)
    ready.add_argument("--greedy", action="store_true")
    bench = commands.add_parser("benchmark", help="search from many roots and append both result tables")
    bench.add_argument("graph")
    bench.add_argument("--searches", type=int, default=64)
    bench.add_argument("--seed", type=int, default=0)
    bench.add_argument("--sources", type=int, nargs="+")
    bench.add_argument("--direction-switch", action="store_true")
    bench.add_argument("--one-by-one", action="store_true", help="run and time each search alone")
    bench.add_argument("--no-validation", action="store_true")
    one = commands.add_parser("search", help="search from one root, write its tree and append its result row")
    one.add_argument("graph")
    one.add_argument("--source", type=int, default=0)
    one.add_argument("--permutation", help="file of new ids; the root is then given, and the tree written, under old ones")
    one.add_argument("--direction-switch", action="store_true")
    one.add_argument("--no-validation", action="store_true")
    for command in (ready, bench, one):
        command.add_argument("--undirected", action="store_true", help="add mirrors, drop self-loops")
    for command in (made, ready, bench, one):
        command.add_argument("--out", required=True)
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> None:
    args = _arguments(given)
    spark = SparkSession.builder.appName("latticework").getOrCreate()
    if args.command == "generate":
        prepare.write(prepare.generate(spark, args.scale, args.edge_factor, args.seed), args.out)
        return
    graph = prepare.load(spark, args.graph, args.undirected)
    if args.command == "balance":
        prepare.write(*_swapped(prepare.balanced(graph, args.grid, args.greedy), args.out))
        return
    name = args.graph.rstrip("/").rpartition("/")[2]
    if args.command == "search":
        built, root, moved = benchmark.build(name, graph), args.source, None
        if args.permutation:
            moved = read_permutation(spark, args.permutation)
            there = translate_source(moved, root).first()
            root = there["new_id"] if there else -1
        ran = benchmark.run_searches(built, benchmark.pick_sources(built, 1, 0, [root]), 0, args.direction_switch, not args.no_validation)
        tree = ran.found if moved is None else with_old_ids(ran.found, moved)
        tree.write.parquet(f"{args.out}/tree-{root}")
        rows = spark.createDataFrame(ran.searches, benchmark.SEARCHES)
        append_rows(rows, f"{args.out}/searches")
        append_rows(spark.createDataFrame(ran.rounds, benchmark.ROUNDS), f"{args.out}/rounds")
        rows.show(truncate=False)
        return
    made = benchmark.run_benchmark(
        spark, name, graph, args.searches, args.seed, args.sources, args.direction_switch, not args.no_validation, args.one_by_one
    )
    for table in ("searches", "rounds", "summary"):
        append_rows(getattr(made, table), f"{args.out}/{table}")
    made.summary.show(truncate=False)


def _swapped(balanced: tuple, out: str) -> tuple:
    graph, perm = balanced
    return graph, out, perm


if __name__ == "__main__":
    main()
