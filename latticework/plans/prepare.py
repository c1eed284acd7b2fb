"""Preparation of graphs: generate or read, make undirected, balance over a grid, relabel, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.operators import balance, blocks, edges
from latticework.plans.tables import stored
from latticework.sources import rmat, writers
from latticework.sources.graphs import Graph, read_graph


def generate(spark: SparkSession, scale: int, edge_factor: int, seed: int = 0) -> Graph:
    """An exact R-MAT graph."""
    return Graph(rmat.rmat(spark, scale, edge_factor, seed), 1 << scale, directed=False)


def load(spark: SparkSession, path: str, undirected: bool = False) -> Graph:
    """A graph file; ``undirected`` adds mirrors and drops self-loops, which is never done unasked."""
    graph = read_graph(spark, path)
    return Graph(edges.symmetrize(graph.edges), graph.n, False) if undirected else graph


def balanced(graph: Graph, grid: int, greedy: bool = False) -> tuple[Graph, DataFrame]:
    """The relabelled graph, its ids padded to a multiple of ``grid``, and perm(old_id, new_id)."""
    kept = stored(graph.edges.select("src", "dst"), "balance-edges")
    perm = stored((balance.balance_greedy if greedy else blocks.balance_serpentine)(kept, graph.n, grid), "balance-perm")
    return Graph(edges.relabel(kept, perm), blocks.block_edge(graph.n, grid) * grid, graph.directed), perm


def write(graph: Graph, path: str, perm: DataFrame | None = None) -> None:
    """``path``.mtx and, with a permutation, ``path``.operm."""
    writers.write_matrix_market(graph.edges, graph.n, f"{path}.mtx")
    if perm is not None:
        writers.write_permutation(perm, f"{path}.operm")
