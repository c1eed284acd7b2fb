"""Exact deduplication over a live index: cuckoo filters in front of bucketed content.

A text's digest is the SHA-256 of what is left of it without white space. The
index holds the live digests twice: as 16-bit fingerprints in one cuckoo filter
per shard, some 2.5 bytes a digest, and in full in ``content``, a table in
buckets by digest. Rows that come in stream through their shard's filter:

* a miss is certainly new; its fingerprint is inserted and its row appended to
  the content. It is never looked up, so texts without a copy are shuffled once,
  as digests, and meet no grouping;
* a hit is verified against the content by full digest, in a join that moves only
  the hits. Hits that turn out to be new are inserted too.

Where a fingerprint finds no place after many evictions, the shard's filter
overflows: the filter stays as it was, the rows that are left wait, and the next
pass builds a filter of twice the size or more from the stored keys and goes on.
``delete`` takes rows out; a digest whose last row goes leaves the filter, and the
same text is new when it comes again.

Equal digests are combined within each input task before they are shuffled, and
join skew is left to AQE, so a text that makes up a third of all rows is a few rows
per task. Filters travel in pieces of ``PIECE`` bytes; a task holds one filter and
one Arrow batch. Everything between two passes is a table in the shared folder.

Null texts count as empty; empty texts, and those of white space only, equal each
other. Of equal texts the row with most code points in the original stays, then
the smallest id (null ids last), then of rows that repeat in full any one, always
exactly one. Ids may be of any type that sorts. Texts are read whole, at any
length. Further columns are not read, so their names cannot clash; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from latticework.llm.scratch import delete_at_exit, discard, fresh_path, materialize

WHITE_SPACE = " \t\n\x0b\x0c\r"
SLOTS = 4
#: Share of slots that a new filter plans to fill.
LOAD = 0.84
EVICTION_ROUNDS = 400
PIECE = 1 << 20
COMBINED_ROWS = 50_000
#: Rows of a shard when an index is laid out: its filter then takes some 2.5 MB.
SHARD_ROWS = 1_000_000

_FILTER, _STORED, _ROW, _FORCED, _GONE = range(5)


def normalised_digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text without white space."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256))


def buckets_for(n: int) -> int:
    """The power of two of buckets that holds ``n`` fingerprints at the planned load."""
    return 1 << max(3, int(np.ceil(n / (SLOTS * LOAD))) - 1).bit_length()


class CuckooFilter:
    """Fingerprints of digests in buckets of four slots; 0 marks a free slot.

    A fingerprint lies in one of two buckets, either of which follows from the other
    and the fingerprint, so entries move without their digest.
    """

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots
        self.mask = np.int64(n_buckets - 1)

    @staticmethod
    def split(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bucket (before the mask) and fingerprint of digests as rows of four words."""
        return (digests[:, 0] >> np.uint64(1)).astype(np.int64), np.maximum(digests[:, 1] & np.uint64(0xFFFF), 1).astype(np.uint16)

    def _other(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return at ^ (prints.astype(np.int64) * 0x5BD1E995 & self.mask)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        first, prints = self.split(digests)
        first &= self.mask
        wanted = prints[:, None]
        return (self.slots[first] == wanted).any(1) | (self.slots[self._other(first, prints)] == wanted).any(1)

    def insert(self, digests: np.ndarray, seed: int = 1) -> bool:
        """Place all digests. False, and nothing changed, if one finds no place."""
        at, prints = self.split(digests)
        at &= self.mask
        before, rng = self.slots.copy(), np.random.default_rng(seed)
        for turn in range(EVICTION_ROUNDS):
            if not len(at):
                return True
            order = np.argsort(at, kind="stable")
            at, prints = at[order], prints[order]
            opens = np.r_[True, at[1:] != at[:-1]]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            free = self.slots[at] == 0
            fits = place < free.sum(1)
            by_free = np.argsort(~free, axis=1, kind="stable")
            self.slots[at[fits], by_free[fits, place[fits]]] = prints[fits]
            at, prints = at[~fits], prints[~fits]
            if turn and len(at):  # one entry of each full bucket makes room
                opens = np.r_[True, at[1:] != at[:-1]]
                column = rng.integers(0, SLOTS, opens.sum())
                evicted = self.slots[at[opens], column]
                self.slots[at[opens], column] = prints[opens]
                prints[opens] = evicted
            at = self._other(at, prints)
        self.slots = before
        return False

    def delete(self, digests: np.ndarray) -> int:
        """Take one fingerprint of each digest out; how many were there."""
        first, prints = self.split(digests)
        first &= self.mask
        done = 0
        for a, b, p in zip(first, self._other(first, prints), prints, strict=True):
            for bucket in (a, b):
                here = np.flatnonzero(self.slots[bucket] == p)
                if len(here):
                    self.slots[bucket, here[0]] = 0
                    done += 1
                    break
        return done


def _words(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _best_first(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The rows by digest, those that stay first, and where each digest begins."""
    order = [("digest", "ascending"), ("chars", "descending"), ("id", "ascending"), ("row", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end"))
    digests = rows["digest"].combine_chunks()
    differs = pc.not_equal(digests.slice(1), digests.slice(0, len(digests) - 1)).to_numpy(zero_copy_only=False)
    return rows, np.flatnonzero(np.r_[True, differs])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each digest of some ten thousand rows of a task, with their number."""

    def combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, opens = _best_first(pa.Table.from_batches(held))
        counts = pa.array(np.add.reduceat(rows["n"].to_numpy(), opens))
        out = rows.take(pa.array(opens))
        yield from out.set_column(out.schema.get_field_index("n"), "n", counts).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= COMBINED_ROWS:
            yield from combined(held)
            held = []
    if held:
        yield from combined(held)


@dataclass
class CuckooIndex:
    """The live digests: ``filters(shard, n_buckets, piece, slots)`` and a table ``content`` in buckets.

    ``content(digest, chars, id, row, n)`` is appended to; rows taken out have a negative ``n``.
    """

    spark: SparkSession
    shards: int
    start_buckets: int
    id_type: object
    filters: DataFrame | None = None
    content: str = ""
    path: str = ""
    resized: int = 0
    buckets: int = 0
    kept: list[DataFrame] = field(default_factory=list)

    @classmethod
    def empty(cls, spark: SparkSession, id_type: object, expected_rows: int, shards: int | None = None) -> CuckooIndex:
        """An index without digests, laid out for ``expected_rows``; it grows beyond them."""
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = shards or max(parts, -(-expected_rows // SHARD_ROWS))
        path = fresh_path(spark, "dedup-content")
        return cls(spark, shards, buckets_for(expected_rows // shards + 1), id_type, path=path, content=path.rsplit("/", 1)[1].replace("-", "_"))

    def release(self) -> None:
        """Drop the index's tables. Results of ``add`` that were not written yet must be read before."""
        for table in [*self.kept, *([self.filters] if self.filters is not None else [])]:
            discard(table)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.content}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _row_schema(self) -> StructType:
        return StructType([
            StructField("digest", BinaryType()), StructField("chars", LongType()), StructField("id", self.id_type),
            StructField("row", LongType()), StructField("n", LongType()),
        ])

    def _append(self, rows: DataFrame) -> None:
        first, n = not self.buckets, self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = rows.select(*self._row_schema().names)
        wanted.repartition(n, "digest").write.mode("append").bucketBy(n, "digest").option("path", self.path).saveAsTable(self.content)
        if first:
            delete_at_exit(self.spark, self.path)
        self.buckets = n

    def _live(self, digests: DataFrame) -> DataFrame:
        """(digest, live, best) of those of ``digests(digest)`` that the content holds alive."""
        best = F.min(F.when(F.col("n") > 0, _order())).alias("best")
        held = self.spark.table(self.content).join(digests, "digest", "left_semi")
        return held.groupBy("digest").agg(F.sum("n").alias("live"), best).where("live > 0")

    def _pass(self, work: DataFrame) -> dict[str, DataFrame]:
        """Stream ``work(shard, kind, ...)`` through the filters of its shards; the tables of what became of it."""
        schema = StructType([
            StructField("what", StringType()), StructField("shard", IntegerType()), StructField("kind", IntegerType()), *self._row_schema().fields,
            StructField("n_buckets", LongType()), StructField("piece", IntegerType()), StructField("slots", BinaryType()),
        ])
        start, given = self.start_buckets, schema.names[1:]
        partitions = min(self.shards, int(self.spark.conf.get("spark.sql.shuffle.partitions")) * 4)
        dealt = work.select(*given).repartition(partitions, "shard").sortWithinPartitions("shard", "kind", "piece")
        path = fresh_path(self.spark, "dedup-pass")
        arrow = _arrow_schema(dealt)
        dealt.mapInArrow(lambda b: _stream(b, start, arrow), schema).write.partitionBy("what").parquet(path)
        delete_at_exit(self.spark, path)
        back = self.spark.read.schema(schema).parquet(path)
        return {what: back.where(F.col("what") == what).drop("what") for what in ("filter", "fresh", "hit", "waiting")} | {"all": back}

    def _work(self, rows: DataFrame, kind: int) -> DataFrame:
        return self._padded(rows.select(self._shard(), F.lit(kind).alias("kind"), *self._row_schema().names))

    def _shard(self) -> Column:
        return F.pmod(F.hash("digest", F.lit(7)), F.lit(self.shards)).cast("int").alias("shard")

    def _padded(self, rows: DataFrame) -> DataFrame:
        """``rows`` with all columns of a pass; those it lacks are null."""
        kinds = {f.name: f.dataType for f in self._row_schema().fields} | {"n_buckets": LongType(), "piece": IntegerType(), "slots": BinaryType()}
        return rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items() if name not in rows.columns])

    def _run(self, rows: DataFrame, kind: int) -> tuple[DataFrame, DataFrame]:
        """Fresh rows and hits of ``rows``; filters that overflow are built anew from the stored keys until nothing waits."""
        work = self._work(rows, kind)
        if self.filters is not None:
            work = work.unionByName(self._padded(self.filters.select("shard", F.lit(_FILTER).alias("kind"), "n_buckets", "piece", "slots")))
        fresh = hits = None
        while True:
            done = self._pass(work)
            self.kept.append(done["all"])
            fresh = done["fresh"] if fresh is None else fresh.unionByName(done["fresh"])
            hits = done["hit"] if hits is None else hits.unionByName(done["hit"])
            changed = done["filter"].select("shard", "n_buckets", "piece", "slots")
            if self.filters is not None:
                others = self.filters.join(changed.select("shard").distinct(), "shard", "left_anti")
                changed = others.select(*changed.columns).unionByName(changed)
            before, self.filters = self.filters, materialize(changed, "dedup-filters")
            if before is not None:
                discard(before)
            if done["waiting"].isEmpty():
                return fresh, hits
            work = self._resized(done["waiting"], fresh, kind)

    def _resized(self, waiting: DataFrame, fresh: DataFrame, kind: int) -> DataFrame:
        """Work that builds larger filters for the shards of ``waiting`` from their stored keys, then goes on.

        Forced rows are in the content already, and so among the stored keys.
        """
        over = materialize(waiting.groupBy("shard").agg(F.count("*").alias("more")), "dedup-over")
        stored = fresh.select("shard", "digest")
        if self.buckets:
            held = self.spark.table(self.content).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 0")
            stored = stored.unionByName(held.select(self._shard(), "digest"))
        keys = materialize(stored.join(over, "shard", "left_semi"), "dedup-keys")
        self.kept += [over, keys]
        sizes = over.join(keys.groupBy("shard").agg(F.count("*").alias("keys")), "shard", "left")
        old = self.filters.groupBy("shard").agg(F.max("n_buckets").alias("old"))
        needed = (F.col("more") + F.coalesce("keys", F.lit(0))) / (SLOTS * LOAD)
        size = F.greatest(F.col("old") * 2, F.pow(F.lit(2), F.ceil(F.log2(F.greatest(needed, F.lit(8.0))))).cast("long"))
        headers = sizes.join(old, "shard").select("shard", F.lit(_FILTER).alias("kind"), size.alias("n_buckets"), F.lit(0).alias("piece"), F.lit(b"").alias("slots"))
        self.resized += over.count()
        rows = self._padded(keys.select("shard", F.lit(_STORED).alias("kind"), "digest")).unionByName(self._padded(headers))
        return rows if kind == _FORCED else rows.unionByName(waiting)

    def add(self, rows: DataFrame) -> DataFrame:
        """Insert ``rows(digest, chars, id, row, n)``; (digest, live, best) of each of their digests with more than one live row.

        ``row`` is a number of its own for every row of the index.
        """
        combined = rows.select(*self._row_schema().names).mapInArrow(_combine, self._row_schema())
        fresh, hits = self._run(combined, _ROW)
        touched = materialize(hits.groupBy("digest").agg(F.sum("n").alias("n"), F.min(_order()).alias("best")), "dedup-touched")
        self._append(fresh)
        verified = materialize(self._live(touched.select("digest")), "dedup-verified")
        false_hits = materialize(_unpacked(touched.join(verified, "digest", "left_anti"), self.id_type), "dedup-new")
        self.kept += [touched, verified, false_hits]
        self._append(hits)
        if not false_hits.isEmpty():
            self._run(false_hits, _FORCED)
        # rows of one task that are equal are one fresh row, and a group without any hit
        pairs = fresh.where("n > 1").join(touched, "digest", "left_anti").select("digest", F.col("n").alias("live"), _order().alias("best"))
        both = touched.select("digest", F.col("n").alias("live"), "best").unionByName(verified)
        groups = both.groupBy("digest").agg(F.sum("live").alias("live"), F.min("best").alias("best")).where("live > 1")
        return materialize(groups.unionByName(pairs), "dedup-groups")

    def delete(self, rows: DataFrame) -> None:
        """Take ``rows(digest, n)`` out, no more of a digest than are live; a digest without a live row leaves its filter.

        While a digest is live, the row that stays for it may be one that was taken out.
        """
        out = materialize(rows.groupBy("digest").agg(F.sum("n").alias("out")), "dedup-out")
        live = self._live(out.select("digest")).join(out, "digest").withColumn("n", F.least("live", "out"))
        live = materialize(live.select("digest", F.lit(None).cast("long").alias("chars"), F.col("best.id").alias("id"), F.lit(None).cast("long").alias("row"), "n", "live"), "dedup-live")
        self.kept += [out, live]
        gone = live.where("n = live").drop("live")
        if not gone.isEmpty():
            self._run(gone, _GONE)
        self._append(live.drop("live").withColumn("n", -F.col("n")))


def _order() -> Column:
    """Smaller is the row that stays."""
    return F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row"))


def _unpacked(groups: DataFrame, id_type: object) -> DataFrame:
    return groups.select("digest", (-F.col("best.less")).alias("chars"), F.col("best.id").cast(id_type).alias("id"), F.col("best.row").alias("row"), "n")


def _arrow_schema(rows: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.schema([pa.field("what", pa.string()), *to_arrow_schema(rows.schema)])


def _stream(batches: Iterator[pa.RecordBatch], start_buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One shard after the other: its filter's pieces, stored keys, then rows; fresh rows, hits, what waits, and the filter come out."""
    shard, held, over, size, pieces = None, None, False, 0, []

    def told(what: str, rows: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(at):
            own = rows.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array([what] * len(at)), *[own[name].cast(schema.field(name).type) for name in schema.names[1:]]], schema=schema)

    def filter_rows() -> Iterator[pa.RecordBatch]:
        if held is None:  # a filter that nothing was put to stays as it is
            return
        raw = held.slots.tobytes()
        for piece, begin in enumerate(range(0, len(raw), PIECE)):
            row = {"what": "filter", "shard": shard, "n_buckets": len(held.slots), "piece": piece, "slots": raw[begin : begin + PIECE]}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        shards, kinds = batch["shard"].to_numpy(zero_copy_only=False), batch["kind"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(shards)], strict=True):
            if begin == end:
                continue
            part, kind = batch.slice(begin, end - begin), int(kinds[begin])
            if shards[begin] != shard:
                yield from filter_rows()
                shard, held, over, size, pieces = int(shards[begin]), None, False, start_buckets, []
            if kind == _FILTER:
                size = part["n_buckets"][0].as_py()
                pieces += part["slots"].to_pylist()
                continue
            if held is None:
                raw = b"".join(pieces)
                held = CuckooFilter(size, np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy() if raw else None)
                pieces = []
            every = np.arange(part.num_rows)
            if over:
                yield from told("waiting", part, every if kind != _STORED else every[:0])
                continue
            words = _words(part["digest"])
            if kind == _GONE:
                held.delete(words)
            elif kind in (_STORED, _FORCED):
                over = not held.insert(words)
                yield from told("waiting", part, every if over and kind == _FORCED else every[:0])
            else:
                _, firsts = np.unique(words.view("V32").ravel(), return_index=True)
                new = firsts[~held.contains(words[firsts])]
                over = not held.insert(words[new])
                if over:
                    yield from told("waiting", part, every)
                    continue
                yield from told("fresh", part, new)
                yield from told("hit", part, np.setdiff1d(every, new, assume_unique=True))
    yield from filter_rows()


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(digest, chars, id, row, n): one row per row of ``docs``, numbered by ``key`` or as they come."""
    text = docs[f"`{text_col}`"]
    chars = F.length(F.coalesce(text, F.lit(""))).cast("long")
    number = F.monotonically_increasing_id() if key is None else key
    return docs.select(normalised_digest(text).alias("digest"), chars.alias("chars"), docs[f"`{id_col}`"].alias("id"), number.alias("row"), F.lit(1).cast("long").alias("n"))


def _judged(rows: DataFrame, shards: int | None = None) -> DataFrame:
    """Stored ``rows`` of ``digest_rows`` with keep_id, group_size and kept, through an index of their own."""
    index = CuckooIndex.empty(rows.sparkSession, rows.schema["id"].dataType, rows.count(), shards)
    groups = index.add(rows)
    index.release()
    alone = F.col("live").isNull()
    return rows.join(groups, "digest", "left").select(
        "id",
        "row",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("live", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        "digest",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of every row of ``docs``; ``keep_id`` is the id of the row that stays."""
    return _judged(materialize(digest_rows(docs, id_col, text_col), "dedup-rows"), shards).drop("row")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    numbered = materialize(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), whole.alias("_row"), F.monotonically_increasing_id().alias("_at")), "dedup-docs")
    rows = materialize(digest_rows(numbered, "id", "text", F.col("_at")), "dedup-rows")
    kept = _judged(rows).where("kept").select(F.col("row").alias("_at"))
    return numbered.join(kept, "_at", "left_semi").select("_row.*")
