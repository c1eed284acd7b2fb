"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from latticework.plans import catalogue

HEADLINES = (
    "bfs_levels", "bfs_parents", "bfs_levels_sparse", "bfs_levels_paths", "bfs_levels_rmat", "bfs_multi_source", "bfs_direction_history",
    "bfs_levels_distributed_g1", "bfs_expand_topdown", "edges_traversed_undirected", "bfs_invalid_parents", "graph500_summary", "symmetrize", "dedup_edges",
    "is_symmetric", "graph_stats", "nnz_per_block", "partition_maxima", "compressed_columns", "csr_offsets", "relabel_edges", "balance_serpentine",
    "density_2d", "decode_timestamps", "phase_stats", "scale_grid_pivot", "round_cycles_explode",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", f"file://{tempfile.mkdtemp(prefix='bench-')}"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    for name in ("out_degree", "bfs_levels_rmat"):  # the first jobs start workers and compile code
        queries[name](spark, sf_dir).count()
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    edges = queries["graph_stats"](spark, sf_dir).first()["nnz"]
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "bfs_edges_per_sec": round(edges / seconds["bfs_levels"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
