"""The cuckoo index: filters, verification, resizing, deletion, and what stays of equal texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import exact_dedup
from latticework.llm.exact_dedup import CuckooFilter, CuckooIndex, digest_rows, exact_groups, keep_one_of_each
from latticework.llm.scratch import materialize


def digests(names: range | list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in names), "<u8").reshape(-1, 4)


def test_filter_never_forgets_and_seldom_errs() -> None:
    held = CuckooFilter(exact_dedup.buckets_for(20_000))
    for at in range(0, 20_000, 2_500):
        assert held.insert(digests(range(at, at + 2_500)))
    assert held.contains(digests(range(20_000))).all()
    assert held.contains(digests(range(50_000, 90_000))).mean() < 0.001
    assert held.delete(digests(range(5_000))) == 5_000
    assert held.contains(digests(range(5_000, 20_000))).all()
    assert held.contains(digests(range(5_000))).mean() < 0.001


def test_filter_that_overflows_stays_as_it_was() -> None:
    held = CuckooFilter(8)
    assert held.insert(digests(range(20)))
    before = held.slots.copy()
    assert not held.insert(digests(range(100, 140)))
    assert (held.slots == before).all()


def normal(text: str | None) -> str:
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict[str, list] = {}
    for i, (key, text) in enumerate(rows):
        groups.setdefault(normal(text), []).append((-len(text or ""), key is None, key or 0, i))
    out = []
    for text, own in groups.items():
        best = min(own)
        for _, none, key, i in own:
            out.append((None if none else key, None if best[1] else best[2], len(own), hashlib.sha256(text.encode()).hexdigest(), (-len(rows[i][1] or ""), none, key) == best[:3]))
    return out


def told(frame: DataFrame) -> list:
    return [(r["id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex(), r["kept"]) for r in frame.collect()]


def plain(rows: list[tuple]) -> list:
    return sorted([[(x is None, x or 0) for x in r] for r in rows])


@pytest.mark.parametrize("shards", [1, 5])
def test_groups_against_brute_force(spark: SparkSession, shards: int) -> None:
    rng = random.Random(shards)
    rows = [(i, rng.choice(["a b", "ab", "a\tb ", "ab ", "x", "", " \n", None, "long " * 3000, f"text {i % 60}", f"only {i}"])) for i in range(700)]
    rows += [(None, "x  "), (None, "nobody"), (-3, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert plain(told(exact_groups(docs, shards=shards))) == plain(brute(rows))


def test_one_of_rows_that_repeat_stays(spark: SparkSession) -> None:
    rows = [(7, "same text")] * 500 + [(7, "same  text")] * 3 + [(1, "sametext"), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = told(exact_groups(docs))
    assert sum(r[4] for r in got) == 2 and {r[1:3] for r in got} == {(7, 504), (2, 1)}


def test_columns_of_any_name_and_other_ids(spark: SparkSession) -> None:
    docs = spark.createDataFrame([("b", "x y", 1, 2), ("a", "xy", 3, 4), ("c", None, 5, 6)], "`doc.id` string, text string, digest int, `a.b` int")
    kept = keep_one_of_each(docs, "doc.id")
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {("b", "x y", 1, 2), ("c", None, 5, 6)}
    assert exact_groups(docs.limit(0), "doc.id").collect() == []
    assert keep_one_of_each(docs.limit(0), "doc.id").collect() == []


def rows_of(spark: SparkSession, ids: range, text: str = "text {}") -> DataFrame:
    docs = spark.createDataFrame([(i, text.format(i)) for i in ids], "doc_id long, text string")
    return materialize(digest_rows(docs, key=F.col("doc_id")), "test-rows")


def test_overflow_resizes_from_stored_keys(spark: SparkSession) -> None:
    index = CuckooIndex.empty(spark, rows_of(spark, range(1)).schema["id"].dataType, 10, shards=2)
    assert index.add(rows_of(spark, range(1500))).collect() == [] and index.resized > 0
    before = index.resized
    again = index.add(rows_of(spark, range(1000, 5000)).withColumn("row", F.col("row") + 10_000))
    assert {r["best"]["id"] for r in again.collect()} == set(range(1000, 1500)) and {r["live"] for r in again.collect()} == {2}
    assert index.resized > before
    assert {r["best"]["id"] for r in index.add(rows_of(spark, range(5000)).withColumn("row", F.col("row") + 20_000)).collect()} == set(range(5000))
    index.release()


def test_deleted_digests_are_new_again(spark: SparkSession) -> None:
    index = CuckooIndex.empty(spark, rows_of(spark, range(1)).schema["id"].dataType, 300, shards=3)
    index.add(rows_of(spark, range(300)))
    index.add(rows_of(spark, range(100)).withColumn("row", F.col("row") + 1000))
    index.delete(rows_of(spark, range(200)))  # 0 to 99 are live once more, 100 to 199 are gone
    found = {r["best"]["id"]: r["live"] for r in index.add(rows_of(spark, range(250)).withColumn("row", F.col("row") + 2000)).collect()}
    assert found == {i: 2 for i in [*range(100), *range(200, 250)]}
    index.delete(rows_of(spark, range(2)).withColumn("n", F.lit(50).cast("long")))
    assert index.add(rows_of(spark, range(2)).withColumn("row", F.col("row") + 3000)).collect() == []
    index.release()


def test_false_hits_are_told_from_copies(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Every row a hit: what is new is still found to be new, and enters the filter."""
    monkeypatch.setattr(CuckooFilter, "contains", lambda self, digests: np.ones(len(digests), bool))
    rows = [(i, f"text {i % 40}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert plain(told(exact_groups(docs))) == plain(brute(rows))
