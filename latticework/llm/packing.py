"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

``token_pieces`` tokenises whole texts in one narrow Arrow pass and cuts only
documents longer than a sequence. ``pack`` puts the pieces into sequences:

1. Pieces that fill a sequence have one of their own.
2. All others are dealt to shards of about ``shard_items`` by a hash of their
   row number, so shards are alike and their size does not follow any key.
3. Each shard is evolved on several islands, rows of a (shard, island) table.
   A solution is a list of whole bins. An island begins with best-fit packings of
   its own noisy orders, the first island also with the one by falling length.
   Crossover injects well-filled bins of one parent into the other, removes the
   bins that hold duplicates, and best-fits the displaced pieces, longest first.
   After each epoch every island sends its elite to the next one, a join of the
   table with itself. An epoch ends with the generation whose best solution meets
   the lower bound ceil(total / capacity), after one generation at least. The
   best solution of all islands counts; how many bins, generations and migrations
   its shard had is told beside it.
4. The least filled bin of each shard is opened again and its pieces are packed
   at the next level, until a level has a single shard, so the loss against one
   global packing is below one bin.

Only lengths and row numbers are shuffled, never texts or ids. Null text counts
as empty and gives the closing id alone. Repeated rows are packed each,
further columns are not read, an empty table gives an empty result. Random
choices are seeded by shard, island and epoch: a task that runs again on another
executor finds the same packing.
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from latticework.llm.batches import small_batches
from latticework.llm.memo import Memo
from latticework.llm.scratch import materialize

#: The tokenizer's own split pattern, and the byte-to-character table of byte-level BPE.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = dict(zip(_PLAIN, map(chr, _PLAIN), strict=True))
_SHOWN |= {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}
_STOPS = ",.;:!?"
#: Runs of these characters split and change case alike in every Unicode version; all others go to the library.
_SIMPLE = re.compile("[!-~\u00a1\u00ab\u00bb\u00bf\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f\u0410-\u044f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+").fullmatch
_NOT_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer


#: Runs that a generation of the memo holds, some 40 MB; half as many cost an eighth more time.
MEMO = 250_000


class WordTokenizer:
    """Ids of a tokenizers file of the lower-casing word-end BPE kind, as packed 32-bit numbers.

    Its pieces never cross white space, so ids are memoised by white-space run. A
    piece in lower case is a run of its own, so runs with capitals or marks around
    a word share the word's ids. Runs with characters whose class or lower case may
    differ between libraries go through the library's own encode.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.bpe = self.whole.model.tokenize
        self.memo = Memo(MEMO)

    def _library(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that is not among the young."""
        ids = self.memo.old(piece)
        if ids is None:
            # ASCII without control characters stands for itself in the byte-to-character table
            shown = piece if piece.isascii() else "".join(map(_SHOWN.__getitem__, piece.encode()))
            ids = array("I", [t.id for t in self.bpe(shown)]).tobytes()
        return self.memo.put(piece, ids)

    def _run(self, run: str) -> bytes:
        """The ids of a run that is not among the young."""
        if not _SIMPLE(run):
            ids = self.memo.old(run)
            return self.memo.put(run, self._library(run) if ids is None else ids)
        low = run.lower()
        if low.isalpha():
            if low == run:
                return self._piece(run)
            parts = (low,)
        else:
            ids = self.memo.old(run)
            if ids is not None:
                return self.memo.put(run, ids)
            parts = (low[:-1], low[-1]) if low[-1] in _STOPS and low[:-1].isalpha() else _SPLIT.findall(low)
        known = self.memo.young.get
        return self.memo.put(run, b"".join([known(p) or self._piece(p) for p in parts]))

    def encode(self, text: str) -> bytes:
        if any(c in text for c in _NOT_SPACE):
            return self._library(text)
        known = self.memo.young.get
        return b"".join([known(r) or self._run(r) for r in text.split()])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32[, ids]) per piece of at most ``capacity`` ids of each document."""
    fields = [
        T.StructField(id_col, docs.schema[id_col].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    schema, names, end = T.StructType(fields), [f.name for f in fields], end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).encode
        for batch in small_batches(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for piece, begin in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[begin : begin + 4 * capacity]
                    at.append(i)
                    rows.append((piece, begin // 4, len(part) // 4, zlib.crc32(part), part if with_ids else b""))
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns += [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[4], "<u4").astype(np.int64) for r in rows], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Bins:
    """A solution: bins of item numbers with their fill."""

    __slots__ = ("fill", "items")

    def __init__(self) -> None:
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, order: list[int], lengths: list[int], capacity: int) -> None:
        """Add items in ``order``, each to the fullest bin that has room."""
        room = sorted((capacity - f, i) for i, f in enumerate(self.fill) if f < capacity)
        for item in order:
            size = lengths[item]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, number = room.pop(at)
                self.items[number].append(item)
                self.fill[number] += size
            else:
                left, number = capacity, len(self.items)
                self.items.append([item])
                self.fill.append(size)
            if left > size:
                insort(room, (left - size, number))

    def quality(self) -> tuple[int, int]:
        """Fewer bins first, then the more uneven fill: larger is better."""
        return -len(self.fill), sum(f * f for f in self.fill)

    def assignment(self, n: int) -> list[int]:
        out = [0] * n
        for number, items in enumerate(self.items):
            for item in items:
                out[item] = number
        return out


def bins_of(assignment: list[int], lengths: list[int]) -> Bins:
    made = Bins()
    n = max(assignment, default=-1) + 1
    made.items, made.fill = [[] for _ in range(n)], [0] * n
    for item, number in enumerate(assignment):
        made.items[number].append(item)
        made.fill[number] += lengths[item]
    return made


def crossover(a: Bins, b: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """The fullest bins of ``b``, up to half of them, enter ``a``; bins of ``a`` with duplicates and its worst go; the displaced are best-fitted."""
    by_fill = sorted(range(len(b.fill)), key=lambda i: (-b.fill[i], rng.random()))
    injected = by_fill[: rng.randint(1, max(1, len(by_fill) // 2))]
    inside = {item for i in injected for item in b.items[i]}
    worst = set(sorted(range(len(a.fill)), key=lambda i: (a.fill[i], rng.random()))[: rng.randint(1, 3)])
    child, displaced = Bins(), []
    for number, items in enumerate(a.items):
        if number in worst or not inside.isdisjoint(items):
            displaced += [x for x in items if x not in inside]
        else:
            child.items.append(list(items))
            child.fill.append(a.fill[number])
    for i in injected:
        child.items.append(list(b.items[i]))
        child.fill.append(b.fill[i])
    displaced.sort(key=lengths.__getitem__, reverse=True)
    child.best_fit(displaced, lengths, capacity)
    return child


def evolve(
    lengths: list[int], capacity: int, population: list[list[int]], rng: random.Random, size: int = 5, generations: int = 30, falling: bool = False
) -> tuple[list[Bins], int]:
    """One epoch on one island: the population after it, best first, and its number of generations.

    Item numbers are in order of falling length; a first epoch of an island that is ``falling`` has the best-fit packing of that order.
    """
    least = -(-sum(lengths) // capacity)
    alive = [bins_of(p, lengths) for p in population]
    if not alive and falling:
        alive.append(Bins())
        alive[0].best_fit(list(range(len(lengths))), lengths, capacity)
    while len(alive) < size:
        noisy = sorted(range(len(lengths)), key=lambda i: -lengths[i] * rng.uniform(0.5, 1))
        other = Bins()
        other.best_fit(noisy, lengths, capacity)
        alive.append(other)
    alive.sort(key=Bins.quality, reverse=True)
    number = 0
    for number in range(1, generations + 1):
        a, b = sorted(rng.sample(range(len(alive)), 2))
        children = [crossover(alive[a], alive[b], lengths, capacity, rng), crossover(alive[b], alive[a], lengths, capacity, rng)]
        alive = sorted([*alive, *children], key=Bins.quality, reverse=True)[:size]
        if len(alive[0].fill) <= least:
            break
    return alive, number


#: Islands that one task evolves, one after the other.
ISLANDS_A_TASK = 16

_STATE = "shard long, island int, lengths array<int>, uids array<long>, population array<array<int>>, bins int, squares long, generations int, migrations int"


_ARROW_STATE = pa.schema([
    ("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("uids", pa.list_(pa.int64())), ("population", pa.list_(pa.list_(pa.int32()))),
    ("bins", pa.int32()), ("squares", pa.int64()), ("generations", pa.int32()), ("migrations", pa.int32()),
])


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            (row,) = batch.to_pylist()
            rng = random.Random(f"{row['shard']}/{row['island']}/{epoch}")
            alive, number = evolve(row["lengths"], capacity, row["population"], rng, falling=row["island"] == 0)
            bins, squares = alive[0].quality()
            best = [b.assignment(len(row["lengths"])) for b in alive]
            after = row | {"population": best, "bins": -bins, "squares": squares, "generations": row["generations"] + number}
            yield pa.RecordBatch.from_pylist([after], _ARROW_STATE)

    return state.mapInArrow(run, _STATE)


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island with the elite of the one before it."""
    sent = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("population", 1, 1).alias("elite"))
    joined = state.join(sent, ["shard", "island"])
    return joined.withColumn("population", F.concat("elite", "population")).withColumn("migrations", F.col("migrations") + 1).drop("elite", "bins", "squares")


def _pack_level(items: DataFrame, capacity: int, level: int, shards: int, islands: int, epochs: int) -> DataFrame:
    """(uid, length, shard, bin, offset, tail) and the shard's bins, generations and migrations; ``tail`` marks the least filled bin of each shard."""
    one = F.struct((-F.col("length")).cast("int").alias("n"), "uid")
    packed = (
        items.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
        .groupBy("shard")
        .agg(F.array_sort(F.collect_list(one)).alias("of"))
        .select("shard", F.transform("of", lambda x: -x["n"]).alias("lengths"), F.col("of.uid").alias("uids"))
    )
    start = packed.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", "uids")
    # an island is few bytes and much work: partitions go by number, not by size
    start = start.repartition(-(-shards * islands // ISLANDS_A_TASK), "shard", "island")
    none = {"population": F.array().cast("array<array<int>>"), "generations": F.lit(0), "migrations": F.lit(0)}
    state = materialize(_epoch(start.withColumns(none), capacity, 0), "pack-epoch")
    for epoch in range(1, epochs):
        state = materialize(_epoch(_migrate(state, islands), capacity, epoch), "pack-epoch")
    best = state.groupBy("shard").agg(
        F.min_by(F.struct("lengths", "uids", F.get("population", 0).alias("assigned"), "bins"), F.struct("bins", -F.col("squares"), "island")).alias("b"),
        F.sum("generations").cast("int").alias("generations"),
        F.sum("migrations").cast("int").alias("migrations"),
    )

    out = "uid long, length long, shard long, bin int, offset long, tail boolean, bins int, generations int, migrations int"
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, out.split(", "))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            (row,) = batch.to_pylist()
            made = bins_of(row["assigned"], row["lengths"])
            tail = min(range(len(made.fill)), key=made.fill.__getitem__)
            rows = []
            for number, members in enumerate(made.items):
                offset = 0
                for item in members:
                    length = row["lengths"][item]
                    rows.append((row["uids"][item], length, row["shard"], number, offset, number == tail, row["bins"], row["generations"], row["migrations"]))
                    offset += length
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return best.select("shard", "b.lengths", "b.uids", "b.assigned", "b.bins", "generations", "migrations").mapInArrow(place, out)


def pack(pieces: DataFrame, capacity: int = 4096, shard_items: int = 2000, islands: int = 3, epochs: int = 3) -> DataFrame:
    """``pieces`` with sequence_id and offset, and bins, generations and migrations of the shard that was evolved (null where a piece fills a sequence).

    ``pieces`` has uid long (unique) and length long, 1 to ``capacity``.
    """
    told = ["bins", "generations", "migrations"]
    full = pieces.where(F.col("length") == capacity).select(
        "uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *[F.lit(None).cast("int").alias(c) for c in told]
    )
    done = [full]
    items = pieces.where(F.col("length") < capacity).select("uid", F.col("length").cast("int").alias("length"))
    level = 0
    while (n := items.count()) > 0:
        shards = -(-n // shard_items)
        placed = materialize(_pack_level(items, capacity, level, shards, islands, epochs), "pack-level")
        number = F.lit(level).cast("long") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bin")
        kept = placed if shards == 1 else placed.where("NOT tail")
        done.append(kept.select("uid", number.alias("sequence_id"), "offset", *told))
        if shards == 1:
            break
        items = placed.where("tail").select("uid", F.col("length").cast("int").alias("length"))
        level += 1
    where = done[0]
    for more in done[1:]:
        where = where.unionByName(more)
    return pieces.join(where, "uid")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, **how: int) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset, bins, generations, migrations) of every piece of every document."""
    cut = token_pieces(docs, path, id_col, text_col, capacity).withColumn("uid", F.monotonically_increasing_id())
    return pack(materialize(cut, "pack-pieces"), capacity, **how).drop("uid")
