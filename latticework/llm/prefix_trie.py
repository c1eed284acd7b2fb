"""Prefix tries of conversations: succinct level-order shards, merged above.

A conversation is a sequence of turns, each a 16-byte label (SHA-256 of role and
text, cut) and its number of words. Sequences are sorted by their labels and then
by id, over range partitions. A run of this order is a prefix shard: numpy builds
its trie level by level as a LOUDS bitvector with a label array, and every count
rolls up from the deepest level to the root with ``add.at``.

A prefix that more than one shard holds lies on the path of the first or the last
sequence of each of them. These paths are the heavy upper levels: the shards hand
over what they know of them, which is merged by prefix, and only this upper trie,
two paths a shard, is rolled up in one place. All other nodes are finished in
their shard. Ids that end at one node come in order from shard to shard.

As the sort goes on to the id, conversations that are equal in full, or share a
long beginning, are dealt to as many shards as they fill; no node's members meet
in one task. A task holds one shard of about ``SHARD_TURNS`` turns, however many
rows its partition has. The digest of the ids that end at a node has to read them
in order: the shards send them in pieces, which pass one task as a stream.

Turns are ordered by turn (null first), then role and label. Null roles and texts
count as empty. Ids are whole numbers; rows without one take no part. A
conversation's labels, 20 bytes a turn, are one value, so they fit a task; texts
are never gathered. Turns that repeat stay, each at its place. Further columns are
not read. Without a conversation there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.scratch import discard, materialize

LABEL = 16
#: Turns of a shard's trie; some 200 bytes a turn are held while it is built.
SHARD_TURNS = 200_000
#: Ids of one piece of a node's list of ends.
PIECE_IDS = 50_000
WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_label(role: Column, text: Column) -> Column:
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(said, 256), 1, 2 * LABEL))


def sequences(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the labelled turns of each conversation, in order. Texts become labels before the shuffle."""
    role, text = (F.coalesce(rows[f"`{c}`"], F.lit("")) for c in (role_col, text_col))
    place = rows[f"`{turn_col}`"]
    turn = F.struct(
        place.isNotNull().alias("known"), place.alias("turn"), role.alias("role"), turn_label(role, text).alias("label"), F.regexp_count(text, F.lit(WORDS)).alias("words")
    )
    labelled = rows.select(rows[f"`{id_col}`"].cast("long").alias("conv_id"), turn.alias("turn")).where("conv_id IS NOT NULL")
    ordered = labelled.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["label"].alias("label"), t["words"].alias("words"))).alias("turns"))


class Louds:
    """A trie in level order: a one for each child of each node, then a zero; and the labels of the nodes below the root."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.packed, self.labels = np.packbits(bits), labels
        self.n = len(labels) + 1

    @classmethod
    def of_degrees(cls, degree: np.ndarray, labels: np.ndarray) -> Louds:
        bits = np.ones(2 * len(degree) + 1, np.uint8)
        bits[1], bits[np.cumsum(degree + 1) + 1] = 0, 0
        return cls(bits, labels)

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=2 * self.n + 1)

    def parents(self) -> np.ndarray:
        """The parent of every node, -1 of the root: the zeros before its one, less the first."""
        return np.flatnonzero(self._bits()) - np.arange(self.n) - 1

    def child_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First child of every node, and the node after the last."""
        first = np.flatnonzero(self._bits() == 0) - np.arange(self.n + 1)
        return first[:-1], first[1:]

    def find(self, path: list[bytes]) -> int | None:
        """The node that the labels of ``path`` lead to."""
        starts, ends = self.child_ranges()
        at = 0
        for label in path:
            at = next((c for c in range(starts[at], ends[at]) if self.labels[c - 1].tobytes() == label), None)
            if at is None:
                return None
        return at


class Shard:
    """The trie of sorted sequences, and what rolls up in it.

    ``upper`` marks the nodes that other shards may hold too; what these know of
    themselves is left out of their ancestors' ``leaves`` and ``saved``.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, labels: np.ndarray, words: np.ndarray):
        rows, pairs = len(ids), int(lengths.sum())
        start = np.r_[0, np.cumsum(lengths)]
        row = np.repeat(np.arange(rows), lengths)
        place = np.arange(pairs) - start[row]
        before = start[np.maximum(row - 1, 0)] + place
        known = (row > 0) & (place < lengths[np.maximum(row - 1, 0)])
        known[known] = (labels[np.flatnonzero(known)] == labels[before[known]]).all(1)
        shared = lengths.copy()
        np.minimum.at(shared, row[~known], place[~known])
        new = place >= shared[row]

        by_level = np.lexsort((row, place))
        node = np.empty(pairs, np.int64)
        node[by_level] = np.cumsum(new[by_level])
        first = by_level[new[by_level]]
        parent = np.where(place[first] > 0, node[first - 1], 0)
        self.n = len(first) + 1
        self.trie = Louds.of_degrees(np.bincount(parent, minlength=self.n), labels[first])
        self.depth = np.r_[0, place[first] + 1]
        self.words = np.r_[0, words[first]].astype(np.int64)
        self.parent = self.trie.parents()
        self.end = np.zeros(rows, np.int64)
        self.end[lengths > 0] = node[start[1:][lengths > 0] - 1]
        self.paths = [np.r_[0, node[start[r] : start[r + 1]]] for r in dict.fromkeys((0, rows - 1))]
        self.upper = np.zeros(self.n, bool)
        for path in self.paths:
            self.upper[path] = True
        self._roll_up(ids)

    def _roll_up(self, ids: np.ndarray) -> None:
        self.members = np.bincount(self.end, minlength=self.n)
        self.least = np.full(self.n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.end, ids)
        begin = np.searchsorted(self.depth, np.arange(self.depth[-1] + 2))
        levels = [(begin[d], begin[d + 1]) for d in range(self.depth[-1], 0, -1)]
        for a, b in levels:
            np.add.at(self.members, self.parent[a:b], self.members[a:b])
            np.minimum.at(self.least, self.parent[a:b], self.least[a:b])
        inner = ~self.upper
        self.children = np.bincount(self.parent[1:][inner[1:]], minlength=self.n)
        self.leaves = (inner & (self.children == 0)).astype(np.int64)
        self.saved = np.where(inner, (self.members - 1) * self.words, 0)
        for a, b in levels:
            np.add.at(self.leaves, self.parent[a:b], self.leaves[a:b])
            np.add.at(self.saved, self.parent[a:b], self.saved[a:b])

    def upper_keys(self) -> dict[int, bytes]:
        """A name for each upper node that is the same in every shard: the digest of the labels that lead to it."""
        keys = {0: hashlib.sha256(b"").digest()[:LABEL]}
        for path in self.paths:
            for above, at in zip(path[:-1], path[1:], strict=True):
                keys[int(at)] = hashlib.sha256(keys[int(above)] + self.trie.labels[at - 1].tobytes()).digest()[:LABEL]
        return keys


_COUNTS = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_SCHEMA = pa.schema([
    ("what", pa.string()), *[(c, pa.int64()) for c in _COUNTS], ("parent_conv_id", pa.int64()), ("ends_sha256", pa.string()), ("words", pa.int64()),
    ("key", pa.binary()), ("parent_key", pa.binary()), ("part", pa.int64()), ("piece", pa.int64()), ("ids", pa.string()), ("bits", pa.binary()), ("labels", pa.binary()),
])
_DDL = (
    f"what string, {', '.join(f'{c} long' for c in _COUNTS)}, parent_conv_id long, ends_sha256 string, words long, "
    "key binary, parent_key binary, part long, piece long, ids string, bits binary, labels binary"
)


def _batch(what: str, columns: dict, n: int) -> pa.RecordBatch:
    arrays = [pa.array([what] * n) if f.name == "what" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _told(shard: Shard, ids: np.ndarray, part: int, piece: int, tries: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes, partial upper nodes and their ends of one shard. ``piece`` numbers the shards of a task."""
    cuts = np.flatnonzero(np.r_[True, shard.end[1:] != shard.end[:-1], True])
    runs = {int(shard.end[a]): (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
    keys = shard.upper_keys()
    counts = {"conv_id": shard.least, "depth": shard.depth, "n_convs": shard.members, "n_children": shard.children, "n_leaves": shard.leaves, "saved_tokens": shard.saved}

    def listed(a: int, b: int) -> str:
        return ",".join(map(str, ids[a:b].tolist()))

    inner = np.flatnonzero(~shard.upper)
    for begin in range(0, len(inner), 10_000):
        at = inner[begin : begin + 10_000]
        above = shard.parent[at]
        yield _batch("node", {c: v[at] for c, v in counts.items()} | {
            "parent_conv_id": np.ma.MaskedArray(shard.least[above], shard.upper[above]).tolist(),
            "parent_key": [keys.get(int(p)) for p in above],
            "ends_sha256": [hashlib.sha256(listed(*runs[int(v)]).encode()).hexdigest() if int(v) in runs else NO_ENDS for v in at],
        }, len(at))
    at = np.array(sorted(keys))
    yield _batch("upper", {c: v[at] for c, v in counts.items()} | {"words": shard.words[at], "key": [keys[int(v)] for v in at], "parent_key": [keys.get(int(shard.parent[v])) for v in at]}, len(at))
    for v in at:
        a, b = runs.get(int(v), (0, 0))
        for begin in range(a, b, PIECE_IDS):
            yield _batch("ends", {"key": [keys[int(v)]], "part": [part], "piece": [(piece << 32) + begin], "ids": [listed(begin, min(b, begin + PIECE_IDS))]}, 1)
    if tries:
        yield _batch("trie", {"part": [part], "piece": [piece], "n_convs": [len(ids)], "bits": [shard.trie.packed.tobytes()], "labels": [shard.trie.labels.tobytes()]}, 1)


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int, tries: bool) -> Iterator[pa.RecordBatch]:
    part, piece, held, turns = TaskContext.get().partitionId(), 0, [], 0

    def built() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([b["conv_id"].to_numpy() for b in held])
        labels = b"".join(k for b in held for k in b["key"].to_pylist())
        words = np.concatenate([b["words"].flatten().to_numpy() for b in held])
        lengths = np.concatenate([b["turns"].to_numpy() for b in held]).astype(np.int64)
        yield from _told(Shard(ids, lengths, np.frombuffer(labels, "<u8").reshape(-1, 2), words), ids, part, piece, tries)

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            slice_ = batch.slice(begin, 256)
            held.append(slice_)
            turns += slice_.num_rows + int(slice_["turns"].to_numpy().sum())
            if turns >= shard_turns:
                yield from built()
                held, turns, piece = [], 0, piece + 1
    if held:
        yield from built()


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper trie, rolled up: children and leaves among its own nodes, tokens that its nodes save."""
    rows = pa.Table.from_batches(list(batches))
    if not rows.num_rows:
        return
    at = {k: i for i, k in enumerate(rows["key"].to_pylist())}
    parent = np.array([-1 if k is None else at[k] for k in rows["parent_key"].to_pylist()])
    depth, members, words, children, leaves, saved, least = (rows[c].to_numpy().copy() for c in ("depth", "n_convs", "words", "n_children", "n_leaves", "saved_tokens", "conv_id"))
    below = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[below], 1)
    more_leaves, more_saved = (children == 0).astype(np.int64), (members - 1) * words  # the shards have counted the rest
    for level in range(int(depth.max()), 0, -1):
        own = np.flatnonzero(depth == level)
        np.add.at(more_leaves, parent[own], more_leaves[own])
        np.add.at(more_saved, parent[own], more_saved[own])
    leaves, saved = leaves + more_leaves, saved + more_saved
    for name, values in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
    above = [None if p < 0 else int(least[p]) for p in parent]
    yield from rows.append_column("parent_conv_id", pa.array(above, pa.int64())).combine_chunks().to_batches()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, whose pieces come in order."""
    key, digest = None, None
    done: list[dict] = []
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        for own, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append({"key": key, "ends_sha256": digest.hexdigest()})
                key, digest = own, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist(done, schema=schema)
        done = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": digest.hexdigest()}], schema=schema)


def _sharded(turns: DataFrame, shard_turns: int, tries: bool) -> DataFrame:
    spark = turns.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["label"])), ""))
    keyed = materialize(
        turns.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"].cast("long")).alias("words"), F.size("turns").cast("long").alias("turns")), "trie-sequences"
    )
    n_turns, n = keyed.agg(F.coalesce(F.sum("turns"), F.lit(0)), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_turns + n) // shard_turns))
    dealt = keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = materialize(dealt.mapInArrow(lambda b: _shards(b, shard_turns, tries), _DDL), "trie-shards")
    discard(keyed)
    return made


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, turns)``, as ``sequences`` makes them.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent; n_convs, n_children, n_leaves,
    saved_tokens (of the node and all below: members but one, times the words of its last text), and the
    SHA-256 of the ids that end at the node. A conv_id occurs once in ``turns``.
    """
    made = _sharded(turns, shard_turns, False)
    upper = made.where("what = 'upper'").groupBy("key", "parent_key", "depth", "words")
    merged = upper.agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    rolled = merged.repartition(1).mapInArrow(_rolled, ", ".join(f"{c} {t}" for c, t in [*merged.dtypes, ("parent_conv_id", "long")]))
    rolled = materialize(rolled, "trie-upper")  # two paths of each shard
    pieces = made.where("what = 'ends'").select("key", "part", "piece", "ids").repartition("key").sortWithinPartitions("key", "part", "piece")
    ended = materialize(pieces.mapInArrow(_ends, "key binary, ends_sha256 string"), "trie-ends")
    columns = ["conv_id", "depth", "parent_conv_id", *_COUNTS[2:], "ends_sha256"]
    above = rolled.join(ended, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*columns)
    nodes = made.where("what = 'node'")
    hung = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id").join(rolled.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key")
    return nodes.where("parent_key IS NULL").select(*columns).unionByName(hung.select(*columns)).unionByName(above)


def prefix_shards(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(part, piece, n_convs, bits, labels): the succinct tries themselves, in the order of the sequences.

    ``bits`` are the packed LOUDS bits, ``labels`` the 16-byte labels of the nodes below the root.
    """
    return _sharded(turns, shard_turns, True).where("what = 'trie'").select("part", "piece", "n_convs", "bits", "labels")
