"""Structure repair against a plain search over all edits, and streams of odd rows."""

from __future__ import annotations

import heapq
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession

from latticework.llm import queries
from latticework.llm.repair import Repairs, kind_of, repaired, verdicts

SHAPE = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def by_search(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cheapest first, then ASCII-least, over strings of initials: uniform-cost search that knows only the pattern's prefixes."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        if i == len(rows) and SHAPE.match(made):
            return cost, audit
        tail = made if len(made) < 3 else ("s" if made[0] == "s" else "") + made[-2:] if made[-1] == "u" else ("s" if made[0] == "s" else "") + "ua"
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        grows = [c for c in "sua" if any(SHAPE.match(made + c + rest) for rest in ("", "a", "ua"))]
        for c in grows:
            if c != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, made + c))
        if i < len(rows):
            initial, truncated, must = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))
            if not must:
                for c in grows:
                    if c == initial:
                        heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, made + c))
                    if c != "s":
                        heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, made + c))
    raise AssertionError


REPAIRS = Repairs()


@settings(max_examples=400)
@given(st.lists(st.tuples(st.sampled_from("suaax"), st.booleans(), st.sampled_from([False, False, True])), max_size=9))
def test_cost_and_audit_against_search(rows: list[tuple[str, bool, bool]]) -> None:
    kinds = bytes(kind_of(*r) for r in rows)
    cost, states = REPAIRS.scan(kinds)
    assert (cost, REPAIRS.audit(kinds, states)) == by_search(rows)


def test_table_stays_small() -> None:
    rng, repairs = random.Random(5), Repairs()
    for _ in range(300):
        kinds = bytes(rng.choices(range(9), k=400))
        cost, states = repairs.scan(kinds)
        assert sum({"D": 3, "I": 2, "K": 0, "R": 2}[c] for c in repairs.audit(kinds, states)) <= cost
    assert len(repairs.vectors) < 60


def brute(rows: list[tuple]) -> tuple:
    """Counts, cost, audit and repaired rows of one conversation's rows in order."""
    seen, faults, kinds = set(), [], []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        kinds.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip([r[1:] for r in rows], [r[1:] for r in rows][1:], strict=False))
    cost, audit = by_search(kinds)
    out, i = [], 0
    for letter in audit:
        row = (None, "", "") if letter == "I" else rows[i]
        i += letter != "I"
        if letter == "D":
            continue
        system = bool(out) and out[0][0][:1] == "s"
        out.append((row[1] if letter == "K" else "assistant" if (len(out) - system) % 2 else "user", row[2]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, out


def test_conversations_against_brute_force(spark: SparkSession) -> None:
    rng = random.Random(2)
    convs = {}
    for c in [*range(60), None]:
        turns, t = [], rng.randrange(3)
        for _ in range(rng.randrange(1, 9)):
            turns.append((t, rng.choice(["system", "user", "assistant", "assistant", "tool", "", "supervisor"]), rng.choice(["Good.", "Yes! \n", "cut of", " ", "", "what?", "x" * 30_000 + "."])))
            t += rng.choice([1, 1, 2])
        convs[c] = turns
    rows = [(c, *r) for c, turns in convs.items() for r in turns]
    rng.shuffle(rows)
    given_ = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA.replace("conv_id", "`conv.id`") + ", audit int, place int").repartition(3)
    judged = verdicts(given_, "conv.id").cache()
    made: dict = {}
    for r in repaired(given_, judged, "conv.id").collect():
        made.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    got = {r["conv_id"]: (*(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")), [x[1:] for x in sorted(made.get(r["conv_id"], []))]) for r in judged.collect()}
    assert got == {c: brute(turns) for c, turns in convs.items()}


def test_nulls_ties_repeats_and_empty_tables(spark: SparkSession) -> None:
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 4, "assistant", "Ho."), (1, 4, "assistant", "Ho."), (2, None, None, "x."), (2, None, None, "x.")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in verdicts(df).collect()}
    assert (got[1]["blank"], got[1]["duplicate"], got[1]["gaps"], got[1]["audit"], got[1]["cost"]) == (1, 1, 0, "DKKD", 6)
    assert (got[2]["duplicate"], got[2]["audit"], got[2]["cost"], got[2]["gaps"]) == (1, "DD", 6, 0)
    assert verdicts(df.limit(0)).collect() == [] and repaired(df.limit(0), verdicts(df.limit(0))).collect() == []


def test_registered_query_with_nulls(spark: SparkSession, tmp_path: Path) -> None:
    import duckdb

    rng = random.Random(7)
    rows = [(rng.choice([None, *range(8)]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice([None, "user", "assistant", "system", ""]), rng.choice([None, "", "Yes.", "no", "So! "]) ) for _ in range(120)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("op11_prefix_trie", "op12_structure_repair"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        ours = queries.queries()[name](spark, str(tmp_path))
        theirs = con.sql(queries.oracle_sql()[name]).fetchall()
        columns = [d[0] for d in con.sql(queries.oracle_sql()[name]).description]
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(map(str, theirs))


if __name__ == "__main__":
    pytest.main([__file__])
