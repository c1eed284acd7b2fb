"""Top-k against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from latticework.llm import topk


def brute(rows: list[tuple], k: int) -> set[tuple]:
    ints = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in {i for i, _ in ints if i % 50 == 0}:
        scores = {(-sum(a * b for a, b in zip(x, w, strict=True)), j) for i, x in ints if i == q for j, w in ints if j != q and len(w) == len(x)}
        out |= {(q, at + 1, j, min(max(-s, -topk.LONG - 1), topk.LONG)) for at, (s, j) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("block_rows", [16, 8192])
def test_against_brute_force(spark: SparkSession, block_rows: int) -> None:
    rng = random.Random(block_rows)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(40)] + [rows[50], rows[7]]
    rows += [(350, None), (500, [0.0, None] * 4), (501, [float("nan")] * 8), (502, [float("inf")] * 8), (None, [1.0] * 8), (550, [0.5] * 3), (551, [0.5] * 3), (600, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ints = df.select("vec_id", topk.quantize(F.col("embedding")).alias("v"))
    got = topk.top_k(ints, ints.where("vec_id % 50 = 0"), "vec_id", "v", 5, block_rows=block_rows, query_rows=3)
    assert {tuple(r) for r in got.collect()} == brute(exact, 5)
    none = ints.limit(0)
    assert topk.top_k(none, none, "vec_id", "v").collect() == []


def test_wide_numbers_are_exact() -> None:
    rng = random.Random(1)
    for scale in (10**3, 10**7, 10**15):
        x = np.array([[rng.randrange(-scale, scale) for _ in range(5)] for _ in range(60)], np.int64)
        ids = np.arange(60)
        got = topk.block_top_k(topk.SortedLists(ids, x), ids[:4], x[:4], 5)[0]
        for q in range(4):
            want = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(x[q], x[j], strict=True)), -topk.LONG - 1), topk.LONG), j) for j in range(60) if j != q)[:5]
            assert [(s, j) for i, j, s in got if i == q] == [(-s, j) for s, j in want]


def test_ties_go_to_the_smaller_id() -> None:
    x = np.ones((200, 4), np.int64)
    got = topk.block_top_k(topk.SortedLists(np.arange(200)[::-1].copy(), x), np.array([0]), x[:1], 5)[0]
    assert [j for _, j, _ in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("scale", [40, 10**6, 10**12])
def test_bounds_keep_the_best_of_any_vectors(scale: int) -> None:
    rng = np.random.default_rng(scale)
    for n, d in ((1, 3), (7, 1), (90, 4), (400, 16)):
        x = np.rint(rng.normal(size=(n, d)) * scale * (rng.random((n, d)) < 0.7)).astype(np.int64)
        ids = rng.integers(0, n, n)  # some stand more than once
        q, names = np.rint(rng.normal(size=(6, d)) * scale).astype(np.int64), rng.integers(0, n, 6)
        got, read = topk.block_top_k(topk.SortedLists(ids, x), names, q, 5)
        want = []
        for i, w in zip(names.tolist(), q.tolist(), strict=True):
            scores = {(-min(max(sum(a * b for a, b in zip(w, v, strict=True)), -topk.LONG - 1), topk.LONG), int(j)) for v, j in zip(x.tolist(), ids.tolist(), strict=True) if j != i}
            want += [(i, j, -s) for s, j in sorted(scores)[:5]]
        assert got == want and ((read > 0) & (read <= 1)).all()


def test_reading_stops_early_where_bounds_close() -> None:
    rng = np.random.default_rng(3)
    # each vector has one large component: its own list tells soon who is near
    x = rng.integers(0, 3, (2000, 24))
    x[np.arange(2000), rng.integers(0, 24, 2000)] += rng.integers(200, 256, 2000)
    q = np.zeros((10, 24), np.int64)
    q[np.arange(10), np.arange(10)] = 250
    _, read = topk.block_top_k(topk.SortedLists(np.arange(2000), x), np.arange(5000, 5010), q, 5)
    assert (read <= 2 / topk.STEPS).all()
    dense = rng.integers(-128, 128, (2000, 24))
    _, all_read = topk.block_top_k(topk.SortedLists(np.arange(2000), dense), np.arange(5000, 5010), dense[:10], 5)
    assert read.mean() < all_read.mean() < 1


def test_columns_may_have_any_names(spark: SparkSession) -> None:
    df = spark.createDataFrame([(0, [1, 2], "a"), (50, [3, 4], "b"), (7, [5, 6], "c")], "v long, id array<long>, block string")
    got = topk.top_k(df, df.where("v % 50 = 0"), "v", "id", 1)
    assert {tuple(r) for r in got.collect()} == {(0, 1, 7, 17), (50, 1, 7, 39)}
