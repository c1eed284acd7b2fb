"""Archives: round trips, revisits, ties, and what is already an archive."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from latticework.llm import warc

PAGES = [
    (3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, "http://b/\r\nWARC-Type: x", "<p>same</p>"), (1, "http://a/z", "<p>same</p>"),
    (4, None, None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (None, "n", "<p>same</p>"), (7, "big", "x" * 300_000), (8, "z", "only here"),
]


def test_round_trip_and_revisits(spark: SparkSession, tmp_path: Path) -> None:
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.resolve_revisits(warc.page_records(pages)), path, records_per_archive=3)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(PAGES)
    for row in got:
        _, url, html = next(p for p in PAGES if p[0] == row["page_id"] and (p[1] or "").split("\r")[0][:8] == (row["url"] or "").split("%")[0][:8] and (p[1] is None) == (row["url"] is None) and len(p[1] or "") <= len(row["url"] or ""))
        body = (html or "").encode()
        assert row["payload_bytes"] == len(body)
        assert row["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert row["payload"] == (body if row["record_type"] == "response" else None)
    kinds = {(r["page_id"], r["url"]): (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[1, "http://a/z"] == ("response", None)
    assert kinds[1, "http://b/"] == kinds[3, "http://a/"] == kinds[None, "n"] == ("revisit", 1)
    assert (kinds[4, None], kinds[5, "u"]) == (("response", None), ("revisit", 4))
    assert all(r["refers_to_record"] == next(x["record_id"] for x in got if x["record_type"] == "response" and x["payload_digest"] == r["payload_digest"]) for r in got if r["refers_to"])


def test_small_payloads_may_all_be_responses(spark: SparkSession) -> None:
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.resolve_revisits(warc.page_records(pages), min_bytes=5).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_rows_that_repeat_in_full_keep_one_payload(spark: SparkSession, tmp_path: Path) -> None:
    rows = [(7, "u", "p")] * 9 + [(9, "v", "p"), (9, "v", "p"), (8, "x", "q"), (None, None, None), (None, None, None), (3, "only", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    warc.write_archives(warc.resolve_revisits(warc.page_records(pages)), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == sorted(
        [(7, "response", 0), *[(7, "revisit", 7)] * 8, *[(9, "revisit", 7)] * 2, (8, "response", 0), (0, "response", 0), (0, "revisit", 0), (3, "response", 0)]
    )
    assert len({r["record_id"] for r in got}) == len(rows)
    kept = {r["record_id"]: r for r in got if r["record_type"] == "response"}
    assert len({r["payload_digest"] for r in kept.values()}) == len(kept)
    assert all(kept[r["refers_to_record"]]["payload_digest"] == r["payload_digest"] for r in got if r["record_type"] == "revisit")


def test_archives_can_be_deduplicated_again(spark: SparkSession, tmp_path: Path) -> None:
    pages = spark.createDataFrame(PAGES[:4] + PAGES[8:], "page_id long, url string, html string")
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    records = warc.page_records(pages)
    plain = warc.resolve_revisits(records, min_bytes=10**9)
    warc.write_archives(plain, first)
    warc.dedupe_archives(spark, first, second)
    got = {(r["page_id"], r["url"]): r for r in warc.read_archives(spark, second).collect()}
    assert got[3, "http://a/"]["record_type"] == "revisit" and got[3, "http://a/"]["refers_to"] == 1
    assert sum(r["record_type"] == "response" for r in got.values()) == 3
    warc.dedupe_archives(spark, second, str(tmp_path / "c"))
    again = {(r["page_id"], r["url"]): r for r in warc.read_archives(spark, str(tmp_path / "c")).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_digest"]) for k, r in again.items()} == {k: (r["record_type"], r["refers_to"], r["payload_digest"]) for k, r in got.items()}


def test_damage_is_noticed() -> None:
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: %d\r\n\r\n" % len(block)
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_archive(gzip.compress(head + block + b"\r\n\r\n")))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse_archive(gzip.compress(head + block[:5])))


def test_members_and_empty_tables(spark: SparkSession, tmp_path: Path) -> None:
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.resolve_revisits(warc.page_records(empty)), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).collect() == []
