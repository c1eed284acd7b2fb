"""WARC archives with revisit records resolved by payload digest.

``resolve_revisits`` shuffles record headers (digest, id, size; never payloads)
by payload digest, finds the original of each group of equal payloads, and joins
it back; ``write_archives`` writes records with fresh headers, payloads only for
originals; ``read_archives`` reads them back by Content-Length.

Only digests that repeat take part in the join. AQE broadcasts that table when
its measured size is below Spark's threshold and otherwise falls back to a sort
merge join, which it can split where one digest holds most records.

Archives are written and read by Spark, so they can lie in any store that Spark
reaches. A file is one gzip member of at most ``records_per_archive`` records;
the reader inflates it in steps and holds one record at a time.

Null payloads count as empty. Among rows of equal payload the smallest id is
the response, ties go to the smaller url; of rows that repeat both one is the
response and the others revisit it, each under a record id of its own, so every
payload is kept exactly once. Null ids sort last. Control characters in header
values are percent-encoded. Further columns are not read; an empty table gives
archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.scratch import materialize

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, record_id string, refers_to long, refers_to_record string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1. 160 bits are eight groups of 20, each four base32 characters."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, record_id) for one record per row."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    named = F.sha1(F.concat_ws("\n", F.col(id_col).cast("string"), F.col(url_col), F.sha1(F.col("payload"))))
    return (
        pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
        .withColumn("payload_digest", base32_sha1(F.col("payload")))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("record_id", _uuid(named))
    )


def _uuid(digest: Column) -> Column:
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _repeated(records: DataFrame, captures: DataFrame) -> DataFrame:
    """``records`` that repeat another one in full: one of each with its payload, the others as headers with ids of their own.

    ``captures`` holds the record ids in question. Copies are counted by input
    partition and dealt out again from these counts, so no task meets more copies
    of one record than a partition of the input holds.
    """
    again = records.join(captures, "record_id", "left_semi")
    one = again.groupBy(*[c for c in records.columns if c != "payload"]).agg(F.first("payload").alias("payload"))
    headers = records.drop("payload").withColumn("part", F.spark_partition_id()).join(captures, "record_id", "left_semi")
    by_part = materialize(headers.groupBy(*headers.columns).agg(F.count("*").alias("copies")), "warc-copies")
    first = by_part.groupBy(F.col("record_id").alias("kept")).agg(F.min("part").alias("least"))
    spare = by_part.join(first, by_part["record_id"] == first["kept"]).withColumn("copies", F.col("copies") - (F.col("part") == F.col("least")).cast("long"))
    dealt = spare.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    named = dealt.withColumn("record_id", _uuid(F.sha1(F.concat_ws("/", F.col("kept"), F.col("part").cast("string"), F.col("copy").cast("string")))))
    others = named.select(*[F.lit(None).cast("string").alias(c) if c == "payload" else F.col(c) for c in records.columns])
    return one.select(*records.columns).unionByName(others)


def resolve_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with record_type, and for revisits refers_to, refers_to_record and refers_to_url.

    Payloads of less than ``min_bytes`` bytes are never looked up: each of their records is a response.
    """
    header = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.coalesce("url", F.lit("")).alias("at"), "record_id", "url")
    large = F.col("payload_bytes") >= min_bytes
    captures = records.where(large).groupBy("payload_digest", "record_id").agg(F.min(header).alias("first"), F.count("*").alias("copies"))
    originals = materialize(
        captures.groupBy("payload_digest")
        .agg(F.min("first").alias("first"), F.sum("copies").alias("n"), F.max("copies").alias("most"))
        .where("n > 1"),
        "warc-originals",
    )
    # rows that repeat in full are rare: they are told apart only where there are some
    if not originals.where("most > 1").isEmpty():
        repeated = materialize(captures.where("copies > 1").select("record_id"), "warc-repeated")
        records = records.join(repeated, "record_id", "left_anti").select(*records.columns).unionByName(_repeated(records, repeated))
    found = originals.select("payload_digest", "first")
    again = F.col("first").isNotNull() & (F.col("payload_bytes") >= min_bytes) & (F.col("record_id") != F.col("first.record_id"))
    return (
        records.join(found, "payload_digest", "left")
        .withColumn("record_type", F.when(again, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(again, F.col("first.page_id")))
        .withColumn("refers_to_record", F.when(again, F.col("first.record_id")))
        .withColumn("refers_to_url", F.when(again, F.col("first.url")))
        .drop("first")
    )


def _safe(value: Column) -> Column:
    for code in range(32):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def record_text(captured: str) -> Column:
    """The WARC record of a resolved row as text, without the two line ends that close it."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("record_type") == "revisit", http).otherwise(F.concat(http, F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)))

    revisit = F.col("record_type") == "revisit"
    headers = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(CRLF),
        F.lit("WARC-Record-ID: <"), F.col("record_id"), F.lit(f">{CRLF}WARC-Date: {captured}{CRLF}"),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", _safe(F.col("refers_to_url"))),
        line("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
    )
    return F.concat(headers, F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(resolved: DataFrame, path: str, records_per_archive: int = 2000, captured: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record per row to gzip files under ``path``."""
    (
        resolved.select(record_text(captured).alias("value"))
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_archive)
        .text(path)
    )


_HEADER = re.compile(rb"([A-Za-z-]+): (.*)")


class _Inflater:
    """Bytes of a gzip file, inflated as they are asked for."""

    def __init__(self, data: bytes, step: int = 1 << 16):
        self.data, self.step, self.at, self.have = memoryview(data), step, 0, bytearray()
        self.stream = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = self.data[self.at : self.at + self.step]
        self.at += len(part)
        while len(part):
            self.have += self.stream.decompress(part)
            part = self.stream.unused_data
            if self.stream.eof:
                self.stream = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (end := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark))
            if not self._more():
                return None
        return self.take(end + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise ValueError("a WARC archive ends inside a record")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """Records of one gzip archive, in order. Digests of payloads are checked."""
    source = _Inflater(data)
    while (head := source.until(b"\r\n\r\n")) is not None:
        fields = dict(m.groups() for m in map(_HEADER.fullmatch, head.split(b"\r\n")) if m)
        block = source.take(int(fields[b"Content-Length"]))
        source.take(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = fields[b"WARC-Type"].decode()
        digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} does not match its digest")

        def number(name: bytes, of: dict = fields) -> int | None:
            return int(of[name]) if name in of else None

        length = re.search(rb"Content-Length: (\d+)", http)
        yield {
            "page_id": number(b"X-Page-ID"),
            "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None,
            "record_type": kind,
            "record_id": fields[b"WARC-Record-ID"].decode().strip("<>"),
            "refers_to": number(b"X-Refers-To-Page-ID"),
            "refers_to_record": fields[b"WARC-Refers-To"].decode().strip("<>") if b"WARC-Refers-To" in fields else None,
            "payload_digest": digest,
            "payload_bytes": int(length[1]) if length else len(payload),
            "payload": payload if kind == "response" else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (RECORD_SCHEMA; without ``payload`` if not asked for)."""
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for record in parse_archive(data.as_py()):
                    held += len(record["payload"] or b"") if payloads else 0
                    rows.append({n: record[n] for n in names})
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, schema)


def dedupe_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0, records_per_archive: int = 2000) -> None:
    """Rewrite archives so that each payload is kept once.

    Responses go through ``resolve_revisits``; revisits already in ``source``
    join the original that their digest leads to. A revisit whose original is
    in no archive is an error in the source and stays a revisit of what it names.
    """
    records = read_archives(spark, source).withColumn("payload", F.col("payload").cast("string"))
    responses = resolve_revisits(records.where("record_type = 'response'").drop("record_type", "refers_to", "refers_to_record"), min_bytes)
    first = (
        responses.where("record_type = 'response'")
        .groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id", "url")).alias("o"))
    )
    revisits = (
        records.where("record_type = 'revisit'")
        .join(first, "payload_digest", "left")
        .withColumn("refers_to", F.coalesce("o.page_id", "refers_to"))
        .withColumn("refers_to_record", F.coalesce("o.record_id", "refers_to_record"))
        .withColumn("refers_to_url", F.col("o.url"))
        .drop("o")
    )
    write_archives(responses.unionByName(revisits), target, records_per_archive)
