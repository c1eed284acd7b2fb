"""Prefix tries: the LOUDS form, shards of any size, shared beginnings, and odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import SparkSession

from latticework.llm import prefix_trie
from latticework.llm.prefix_trie import Louds, prefix_shards, sequences
from latticework.llm.prefix_trie import prefix_trie as trie_of

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below: dict[tuple, list[tuple]] = {k: [] for k in members}
    for k in members:
        for d in range(len(k) + 1):
            below[k[:d]].append(k)
    children = {k: sum(len(x) == len(k) + 1 for x in below[k]) for k in members}
    out = set()
    for k, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(k))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split(" ") if x[-1][1] else []) for x in below[k] if x)
        out.add((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], sum(not children[x] for x in below[k]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def table(spark: SparkSession, convs: dict[int, list[tuple[str, str]]]):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def told(frame) -> list[tuple]:
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in frame.collect()]


def made_up(rng: random.Random, n: int) -> dict[int, list[tuple[str, str]]]:
    convs = {}
    for c in range(n):
        kind = rng.random()
        if kind < 0.3:
            turns = [("user", "the same"), ("assistant", "answer to all"), ("user", "thanks")]
        elif kind < 0.5:
            turns = [("user", "the same")] + [("assistant", f"answer {rng.randrange(3)}")] * rng.randrange(1, 4)
        else:
            turns = [(rng.choice("ua"), " ".join("w" * rng.randrange(1, 3))) for _ in range(rng.randrange(1, 6))]
        convs[c * rng.choice([1, 1, -1])] = turns
    return convs


@pytest.mark.parametrize("shard_turns", [1, 40, 100_000])
def test_nodes_against_brute_force(spark: SparkSession, shard_turns: int) -> None:
    convs = made_up(random.Random(shard_turns), 160)
    got = told(trie_of(sequences(table(spark, convs)), shard_turns))
    assert len(got) == len(set(got)) and set(got) == brute(convs)


def test_one_deep_conversation_and_its_copies(spark: SparkSession) -> None:
    deep = [("user", f"turn {i}") for i in range(300)]
    convs = {c: deep for c in range(5)} | {9: deep[:150], 10: [("user", "else")]}
    assert set(told(trie_of(sequences(table(spark, convs)), 500))) == brute(convs)


def test_conversations_without_turns(spark: SparkSession) -> None:
    convs = spark.createDataFrame([(3, []), (5, []), (4, [(b"a" * 16, 2)])], "conv_id long, turns array<struct<label: binary, words: int>>")
    ends = hashlib.sha256(b"3,5").hexdigest(), hashlib.sha256(b"4").hexdigest()
    assert set(told(trie_of(convs))) == {(3, 0, None, 3, 1, 1, 0, ends[0]), (4, 1, 3, 1, 0, 1, 0, ends[1])}
    assert set(told(trie_of(convs.where("conv_id < 4")))) == {(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())}
    assert told(trie_of(convs.limit(0))) == []


def test_odd_rows(spark: SparkSession) -> None:
    rows = [(None, 0, "user", "x"), (1, None, "b", "first"), (1, 0, None, None), (1, 0, "", ""), (1, 2, "a", "w " * 50_000), (2, 5, "b", "first"), (2, 6, "", None)]
    given = spark.createDataFrame([(*r, 1, 2) for r in rows], "`conv.id` long, turn long, role string, text string, turns int, label int")
    own = {r["conv_id"]: [(x["label"], x["words"]) for x in r["turns"]] for r in sequences(given, "conv.id").collect()}
    assert own.keys() == {1, 2} and [w for _, w in own[1]] == [1, 0, 0, 50_000] and own[1][:2] == own[2] and own[1][1] == own[1][2]


def test_louds_navigates() -> None:
    labels = np.frombuffer(b"".join(bytes([c]) * 16 for c in b"abcdef"), "<u8").reshape(-1, 2)
    trie = Louds.of_degrees(np.array([2, 1, 2, 0, 1, 0, 0]), labels)  # a b below the root; c below a; d e below b; f below d
    assert trie.parents().tolist() == [-1, 0, 0, 1, 2, 2, 4]
    assert [trie.find([bytes([c]) * 16 for c in path]) for path in (b"", b"a", b"ac", b"bd", b"bdf", b"ad", b"x")] == [0, 1, 3, 4, 6, None, None]


def test_shards_hold_the_sequences(spark: SparkSession) -> None:
    convs = made_up(random.Random(8), 120)
    turns = sequences(table(spark, convs))
    shards = [Louds(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=2 * (len(r["labels"]) // 16) + 3), np.frombuffer(r["labels"], "<u8").reshape(-1, 2)) for r in prefix_shards(turns, 60).collect()]
    assert len(shards) > 4
    for row in turns.collect():
        path = [bytes(x["label"]) for x in row["turns"]]
        assert any(s.find(path) is not None for s in shards)
    assert prefix_trie.LABEL == 16
