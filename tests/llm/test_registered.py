"""The registered queries on the smallest tables: against SQL where there is some, else against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import SparkSession
from test_simhash import brute_components, brute_fingerprint
from tokenizers import Tokenizer

from latticework.llm import pii, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def documents() -> dict[int, str]:
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall())


def run(spark: SparkSession, name: str) -> list:
    return queries.queries()[name](spark, str(DATA)).collect()


def _plain(value: object) -> tuple:
    if value is None or isinstance(value, float) and math.isnan(value):
        return (0, 0, "")
    return (2, 0, str(value)) if isinstance(value, str | bool | np.bool_) else (1, round(float(value), 6), "")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark: SparkSession, name: str) -> None:
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ours, theirs = queries.queries()[name](spark, str(DATA)), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert sorted(theirs.columns) == columns
    left = sorted([_plain(r[c]) for c in columns] for r in ours.collect())
    assert left == sorted([_plain(v) for v in row] for row in theirs[columns].astype(object).where(theirs[columns].notna(), None).itertuples(index=False))


def test_pseudonyms_restore(spark: SparkSession, documents: dict[int, str]) -> None:
    got = {r["doc_id"]: r for r in run(spark, "op1_pii_pseudonyms")}
    assert got.keys() == documents.keys()
    assert all(pii.pseudonymize_text(got[i]["text"], queries.DEMO_KEY, -1)[0] == t for i, t in documents.items())
    assert sum(r["n_email"] + r["n_card"] + r["n_phone"] for r in got.values()) > 0
    assert all((got[i]["text"] != t) == any(got[i][f"n_{k}"] for k in pii.KINDS) for i, t in documents.items())


def test_near_duplicates(spark: SparkSession, documents: dict[int, str]) -> None:
    fp = {i: brute_fingerprint(t, 3) for i, t in documents.items()}
    group = brute_components(sorted(fp, reverse=True), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 2)
    want = {(i, f"{fp[i]:016x}", min(j for j in fp if group[j] == group[i])) for i in fp}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op3_simhash_near_dedup")} == want


def test_byte_bpe(spark: SparkSession, documents: dict[int, str]) -> None:
    lines = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, text in documents.items():
        ids = library.encode_ordinary(text)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in run(spark, "op7_byte_bpe")} == want


def test_packing(spark: SparkSession, documents: dict[int, str]) -> None:
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = set(), 0
    for i, text in documents.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        want |= {(i, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    got = run(spark, "op10_best_fit_packing")
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(sequences) <= -(-total // 4096) + 1
    assert all(r["generations"] >= 9 and r["migrations"] == 6 for r in got if r["length"] < 4096)


@pytest.mark.parametrize(("name", "cut"), [("op6_rule_ensemble", 0.5), ("op9_nearest_toxic", 0.7)])
def test_scores(spark: SparkSession, documents: dict[int, str], name: str, cut: float) -> None:
    got = run(spark, name)
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
