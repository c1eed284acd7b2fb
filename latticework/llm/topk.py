"""Exact top-k inner products by no-random-access aggregation of sorted lists.

Every dimension of a block of candidates is a list sorted by value; a query with
weight q_d reads list d from its top if q_d > 0 and from its bottom if q_d < 0.
Lists are read in step, a slab of ``1 / STEPS`` of them at a time. After each
slab a candidate's score is at least what was seen plus the worst value of its
unseen lists, and at most what was seen plus the value reached in its unseen
lists. Candidates whose upper bound is below the k-th best lower bound are given
up. A query stops reading as soon as no more than ``RESOLVE`` times k candidates,
or ``RESOLVE_SHARE`` of the block, can still be among its k best; these get their
exact scores, the others never do. Which entries a slab holds does not depend on
the query, so the sums of all queries that still read are a few matrix products
over the candidates that any of them still has.

Distribution: candidates and queries are cut into blocks by a hash of the row.
Each query block is sent to every candidate block by its number (the stated query
set against all rows, in blocks). A block's candidates travel once: its task reads
them first, sorted before the query blocks, then streams these. A pair of blocks
yields k rows a query; the k best of all are kept by a ranked window, which cuts
to k rows a query on the map side before it shuffles. Blocks have a bounded
number of rows, so memory does not depend on the table.

Scores are exact: survivors are multiplied in float32 or float64 only while every
partial sum is an integer that the type holds, else in Python integers; a score
outside the range of long saturates. Bounds of such wide numbers are float64
with an allowance above their rounding error.

Inner products of dense vectors spread over all dimensions, so their bounds close
late, at three quarters and more of the lists; vectors in clusters or with few
large components close early (``block_top_k`` returns how much was read).

Vectors that are null or hold a null or non-finite component take no part, nor
does one whose length differs from the query's. A row is known by its id: a
query is not matched with rows of its own id, and rows that repeat an id and a
score count once. Null ids take no part. Further columns are not read, an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG = (1 << 63) - 1
STEPS = 16
RESOLVE, RESOLVE_SHARE = 4, 0.01


def quantize(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) per component as long; null unless all components are finite numbers."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * factor)))


def _exact_type(x: np.ndarray, q: np.ndarray) -> type:
    most = int(np.abs(x.astype(object)).max(initial=0)) * int(np.abs(q.astype(object)).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else object


class SortedLists:
    """The sorted lists of a block of candidates, one per dimension, and each candidate's place in them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        #: rows that share an id, at most: so many rows may hold one place of the k best
        self.repeats = int(np.unique(ids, return_counts=True)[1].max(initial=1))


def _survivors(lists: SortedLists, q: np.ndarray, k: int, own: np.ndarray, slack: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per query the rows that may be among its k best, and the share of the lists that it read. ``own`` masks its own rows."""
    n, kind = len(lists.x), q.dtype
    k, found, read = k * lists.repeats, [np.empty(0, np.int64)] * len(q), np.ones(len(q))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    low, high = lists.sorted[0].astype(kind), lists.sorted[-1].astype(kind)
    asks, rows = np.arange(len(q)), np.arange(n)  # the queries that still read, the candidates that any of them has
    alive = ~own
    worst = (up * low + down * high).sum(1)[:, None] * np.ones((1, n), kind)  # of the unseen lists
    seen = np.zeros((len(q), n), kind)
    before = 0
    for step in range(1, STEPS + 1):
        depth = max(min(n, -(-n * step // STEPS)), 1)
        place, x = lists.place[rows], lists.x[rows].astype(kind)
        top, bottom = ((place >= n - depth) & (place < n - before)).astype(kind), ((place >= before) & (place < depth)).astype(kind)
        u, d = up[asks], down[asks]
        seen += u @ (x * top).T + d @ (x * bottom).T
        worst -= (u * low) @ top.T + (d * high) @ bottom.T
        before = depth
        if depth < n:
            # unseen lists hold at most what was reached in them
            below, above = (place < n - depth).astype(kind), (place >= depth).astype(kind)
            best = (u * lists.sorted[n - depth].astype(kind)) @ below.T + (d * lists.sorted[depth - 1].astype(kind)) @ above.T
        else:
            best = worst = np.zeros_like(seen)
        # clipped as scores are: those beyond the range of long tie
        lower, upper = np.where(alive, np.clip(seen + worst, -(2.0**63), 2.0**63), -np.inf), np.clip(seen + best, -(2.0**63), 2.0**63)
        if n > k:
            # the k-th best lower bound among those alive; who was given up cannot be above it
            have = lower.shape[1]
            bound = -np.partition(-lower, k - 1, axis=1)[:, k - 1 : k] if have > k else np.full((len(asks), 1), -np.inf)
            alive = alive & (upper >= bound - slack[asks][:, None])
        left = alive.sum(1)
        done = (left <= max(RESOLVE * k, RESOLVE_SHARE * n)) | (depth >= n)
        for i in np.flatnonzero(done):
            found[asks[i]], read[asks[i]] = rows[alive[i]], depth / n
        if done.all():
            break
        keep = ~done
        some = alive[keep].any(0)
        asks, rows, alive = asks[keep], rows[some], alive[keep][:, some]
        seen, worst = seen[keep][:, some], worst[keep][:, some]
    return found, read


def block_top_k(lists: SortedLists, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query id, candidate id, score) of each query's k best in the block, ties to the smaller id; and the share of the lists each query read."""
    kind, x = _exact_type(lists.x, q), lists.x
    own = query_ids[:, None] == lists.ids[None, :]
    bounds = np.float64 if kind is object else kind
    most = np.abs(lists.x.astype(float)).max(axis=0, initial=0)
    slack = np.abs(q.astype(float)) @ most * (64 * (q.shape[1] + STEPS) * 2.0**-52 if kind is object else 0.0)
    survivors, read = _survivors(lists, q.astype(bounds), k, own, slack)
    out: list[tuple[int, int, int]] = []
    for i, at in enumerate(survivors):
        scores = x[at].astype(kind) @ q[i].astype(kind)
        if len(at) > k * lists.repeats and kind is not object:
            cut = len(at) - k * lists.repeats
            best = scores >= np.partition(scores, cut)[cut]
            at, scores = at[best], scores[best]
        rows = sorted({(-min(max(int(s), -LONG - 1), LONG), int(lists.ids[j])) for s, j in zip(scores, at, strict=True)})[:k]
        out += [(int(query_ids[i]), vec, -s) for s, vec in rows]
    return out, read


def _by_length(items: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) by number of components."""
    by: dict[int, list] = {}
    for item in items:
        by.setdefault(len(item["v"]), []).append(item)
    return {size: (np.array([o["id"] for o in own], np.int64), np.array([o["v"] for o in own], np.int64).reshape(len(own), size)) for size, own in by.items()}


def top_k(
    candidates: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5, block_rows: int = 8192, query_rows: int = 512
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products of integer vectors.

    Both inputs have ``id_col`` and ``vector_col`` array<long>, under any names.
    """
    rows, asks = (
        d.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
        for d in (candidates, queries)
    )
    n_rows, n_asks = rows.count(), asks.count()
    n_blocks, n_groups = max(1, -(-n_rows // block_rows)), max(1, -(-n_asks // query_rows))
    key, one = F.xxhash64("id", "v"), F.collect_list(F.struct("id", "v")).alias("items")
    packed = rows.groupBy(F.pmod(key, F.lit(n_blocks)).cast("int").alias("block")).agg(one).select("block", F.lit(-1).alias("part"), "items")
    groups = asks.groupBy(F.pmod(key, F.lit(n_groups)).cast("int").alias("part")).agg(one)
    sent = groups.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "part", "items")
    stream = packed.unionByName(sent).repartition("block").sortWithinPartitions("block", "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, lists = None, {}
        for frame in frames:
            for block, part, items in zip(frame["block"], frame["part"], frame["items"], strict=True):
                if part < 0:
                    at, lists = block, {size: SortedLists(ids, x) for size, (ids, x) in _by_length(items).items()}
                    continue
                found = []
                for size, (ids, q) in _by_length(items).items():
                    if block == at and size in lists:
                        found += block_top_k(lists[size], ids, q, k)[0]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = stream.mapInPandas(run, "query_id long, vec_id long, score long").distinct()
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
