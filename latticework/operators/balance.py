"""Greedy balancing of a grid of blocks, in rounds instead of row by row.

Rows by falling degree go to the bands whose fullest block is emptiest. What a row
adds to a band are its edges by block column, so one aggregation gives the load
vectors of all rows. The heaviest rows, ``HEAD`` times the grid, are placed one by one
against the table of loads, P x P numbers. The others follow in batches of ranks, each
``GROWTH`` times as large: a batch's loads are levelled over the bands, which tells
how many rows of it each band takes without its fullest block passing the common
height, and no more than it has room for; the rows of the batch are dealt by a stride
that is prime to its length, so that every band gets rows from all over the batch. What
the bands really got is then counted, and the next batch evens it out. A batch is one
job over the load vectors; the number of batches is the logarithm of the rows.

Columns are relabelled as rows are, so passes repeat, with the columns where the best
pass put them, while the balance improves. The driver holds numbers by band and block
column, and by batch, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.blocks import all_degrees, block_edge, nnz_per_block
from latticework.operators.edges import with_global_rank
from latticework.plans.tables import discard, stored

HEAD, GROWTH = 4, 2
#: Vertices above which a table of one row a vertex is hashed by shuffle; up to it the planner may broadcast it.
HASHED = 1_000_000


def batch_bounds(rows: int, grid: int) -> list[int]:
    """Where the batches of ranks begin and end; the first is the head."""
    bounds = [0, min(rows, HEAD * grid)]
    while bounds[-1] < rows:
        bounds.append(min(rows, GROWTH * bounds[-1]))
    return bounds


def place_head(vectors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The band of each of some rows, placed one by one, with the loads and the places taken after it."""
    grid = vectors.shape[1]
    loads, used, bands = np.zeros((grid, grid), np.int64), np.zeros(grid, np.int64), np.empty(len(vectors), np.int64)
    peaks = loads.max(1)
    for row, vector in enumerate(vectors):
        open_bands = np.flatnonzero(used < size)
        band = open_bands[np.argmin(peaks[open_bands])]
        bands[row] = band
        loads[band] += vector
        used[band] += 1
        peaks[band] = loads[band].max()
    return bands, loads, used


def level(loads: np.ndarray, room: np.ndarray, vector: np.ndarray, rows: int) -> np.ndarray:
    """How many of ``rows`` equal rows with loads ``vector`` in all each band takes, so that the fullest blocks are level."""
    some = vector > 0
    if not some.any():  # rows without edges fill what is free
        taken = np.minimum(room, np.maximum(0, rows - np.r_[0, np.cumsum(room)[:-1]]))
        return taken

    def shares(height: float) -> np.ndarray:
        return np.clip(((height - loads[:, some]) * rows / vector[some]).min(1), 0, room)

    low, high = 0.0, float(loads.max() + vector.max() * len(loads) + 1)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if shares(middle).sum() < rows else (low, middle)
    wanted = shares(high)
    taken = np.minimum(np.floor(wanted).astype(np.int64), room)
    while (left := rows - int(taken.sum())) > 0:
        free = np.flatnonzero(taken < room)
        first = free[np.argsort(-(wanted - taken)[free], kind="stable")][:left]
        taken[first] += 1
    while (over := int(taken.sum()) - rows) > 0:
        some_taken = np.flatnonzero(taken)
        taken[some_taken[np.argsort((wanted - taken)[some_taken], kind="stable")][:over]] -= 1
    return taken


@dataclass
class Deal:
    """Rows of ranks from ``begin`` on, dealt to bands: ``rows`` of them, ``ends`` the running total of the bands' shares."""

    begin: int
    rows: int
    ends: np.ndarray
    used: np.ndarray

    def stride(self) -> int:
        step = max(1, round(self.rows / ((1 + 5**0.5) / 2)))
        while math.gcd(step, self.rows) != 1:
            step += 1
        return step

    def placed(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band, and place in it, of each rank: a bijection onto the shares of the bands."""
        at = (ranks - self.begin) * self.stride() % self.rows
        band = np.searchsorted(self.ends, at, side="right")
        return band, self.used[band] + at - np.r_[0, self.ends][band]


@dataclass
class Placement:
    """Bands and places of all ranks: the head's row by row, the rest by deals."""

    size: int
    head: np.ndarray
    deals: list[Deal]

    def new_ids(self, ranks: np.ndarray) -> np.ndarray:
        out = np.empty(len(ranks), np.int64)
        order = np.argsort(self.head, kind="stable")
        places = np.empty(len(self.head), np.int64)
        sorted_bands = self.head[order]
        places[order] = np.arange(len(order)) - np.searchsorted(sorted_bands, sorted_bands)
        own = ranks < len(self.head)
        out[own] = self.head[ranks[own]] * self.size + places[ranks[own]]
        for deal in self.deals:
            own = (ranks >= deal.begin) & (ranks < deal.begin + deal.rows)
            band, place = deal.placed(ranks[own])
            out[own] = band * self.size + place
        return out


def _with_new_ids(rows: DataFrame, rank: str, placement: Placement, name: str) -> DataFrame:
    """``rows`` with the new id of the row whose rank they name."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, pa.array(placement.new_ids(batch[rank].to_numpy())))

    return rows.mapInArrow(place, ", ".join([*[f"{c} {t}" for c, t in rows.dtypes], f"{name} bigint"]))


def _one_pass(vectors: DataFrame, rows: int, grid: int, size: int) -> Placement:
    """A placement by ``vectors(rank, col_b, load)``, the edges of each row by block column."""
    bounds = batch_bounds(rows, grid)
    head = np.zeros((bounds[1], grid), np.int64)
    for r in vectors.where(F.col("rank") < bounds[1]).collect():  # HEAD * P rows of P numbers
        head[r["rank"], r["col_b"]] = r["load"]
    bands, loads, used = place_head(head, size)
    batch = F.lit(0)
    for i, begin in enumerate(bounds[1:-1]):
        batch = F.when(F.col("rank") >= begin, i + 1).otherwise(batch)
    totals = np.zeros((len(bounds), grid), np.int64)
    for r in vectors.groupBy(batch.alias("batch"), "col_b").agg(F.sum("load").alias("load")).collect():  # batches times P numbers
        totals[r["batch"], r["col_b"]] = r["load"]
    placement = Placement(size, bands, [])
    for i, (begin, end) in enumerate(zip(bounds[1:-1], bounds[2:], strict=True)):
        taken = level(loads, size - used, totals[i + 1], end - begin)
        deal = Deal(begin, end - begin, np.cumsum(taken), used.copy())
        placement.deals.append(deal)
        used = used + taken
        if end < rows and totals[i + 1].any():
            own = _with_new_ids(vectors.where(F.col("rank").between(begin, end - 1)), "rank", Placement(size, bands[:0], [deal]), "new_id")
            got = own.groupBy(F.expr(f"new_id div {size}").alias("band"), "col_b").agg(F.sum("load").alias("load"))
            for r in got.collect():  # P * P numbers
                loads[r["band"], r["col_b"]] += r["load"]
    return placement


def balance_factor(edges: DataFrame, n: int, grid: int) -> float:
    """Edges over P * P times those of the fullest block; 1 for a graph without edges."""
    row = nnz_per_block(edges, n, grid).agg(F.sum("nnz").alias("nnz"), F.max("nnz").alias("most")).first()
    return row["nnz"] / (grid * grid * row["most"]) if row["most"] else 1.0


def _hashed(by_vertex: DataFrame, n: int) -> DataFrame:
    return by_vertex.hint("shuffle_hash") if n > HASHED else by_vertex


def load_vectors(edges: DataFrame, ranked: DataFrame, n: int, size: int, perm: DataFrame | None) -> DataFrame:
    """vectors(rank, col_b, load): the edges of each row by block column, columns where ``perm(old_id, new_id)`` puts them.

    Edges are streamed past a hash of the permutation, one row a vertex, and combined where they are
    met: no task sorts edges, and what is joined with the ranks are loads.
    """
    columns = edges.select("dst", "src")
    if perm is not None:
        columns = columns.join(_hashed(perm.select(F.col("old_id").alias("src"), F.col("new_id").alias("at")), n), "src")
    placed = columns.select(F.col("dst").alias("vertex"), F.expr(f"{'src' if perm is None else 'at'} div {size}").alias("col_b"))
    loads = placed.groupBy("vertex", "col_b").agg(F.count("*").alias("load"))
    return loads.join(_hashed(ranked, n), "vertex").select("rank", "col_b", "load")


def placed_factor(vectors: DataFrame, placement: Placement, grid: int) -> float:
    """``balance_factor`` of the graph whose rows go where ``placement`` says and whose loads by column are ``vectors``."""
    own = _with_new_ids(vectors, "rank", placement, "new_id").groupBy(F.expr(f"new_id div {placement.size}").alias("band"), "col_b")
    row = own.agg(F.sum("load").alias("nnz")).agg(F.sum("nnz").alias("nnz"), F.max("nnz").alias("most")).first()
    return row["nnz"] / (grid * grid * row["most"]) if row["most"] else 1.0


def balance_greedy(edges: DataFrame, n: int, grid: int) -> DataFrame:
    """perm(old_id, new_id), ids padded to a multiple of the grid; ties of degree go by id.

    A pass reads the edges once: their loads under its permutation tell its factor, and are what the next pass places.
    """
    size = block_edge(n, grid)
    padded = size * grid
    ranked = with_global_rank(all_degrees(edges, padded), [F.col("degree").desc(), F.col("vertex")], "rank")
    ranked = stored(ranked.select("vertex", "rank"), "balance-ranks")
    best, best_factor = None, 0.0
    vectors = stored(load_vectors(edges, ranked, padded, size, None), "balance-vectors")
    while True:
        placement = _one_pass(vectors, padded, grid, size)
        discard(vectors)
        perm = stored(_with_new_ids(ranked, "rank", placement, "new_id").select(F.col("vertex").alias("old_id"), "new_id"), "balance-perm")
        vectors = stored(load_vectors(edges, ranked, padded, size, perm), "balance-vectors")
        factor = placed_factor(vectors, placement, grid)
        if factor <= best_factor:
            for table in (ranked, vectors, perm):
                discard(table)
            return best
        if best is not None:
            discard(best)
        best, best_factor = perm, factor
