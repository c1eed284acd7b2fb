"""SimHash near-duplicate groups with pivot distance tables.

Plan
----
1. ``fingerprints``: one Arrow pass over the texts gives a 64-bit SimHash.
2. Equal fingerprints collapse (map-side combined group-by), so exact copies
   cost one row from here on.
3. ``pivot_table``: Hamming distances of each distinct fingerprint to a fixed
   set of reference fingerprints, the coordinates of the triangle inequality.
4. Candidate pairs meet in buckets. 64 bits are cut into ``max_bits + 2`` blocks;
   a pair within ``max_bits`` leaves two blocks untouched, so it shares the
   bucket of at least one pair of blocks. No pair can be missed.
5. Pairs whose coordinates differ by more than ``max_bits`` at any pivot are
   discarded, survivors are verified by the exact Hamming distance.
6. Buckets above ``bucket_limit`` fingerprints are not paired up. For
   ``max_bits = 2`` their members instead meet at *midpoints*: two fingerprints
   are within two bits if and only if some value is within one bit of both, so
   65 rows each link them exactly, and linearly in the size of the bucket.
7. Components of the links, folded back onto the documents.

``similar_groups`` is the same plan for a wide similarity (0.8 of five-word
shingles by default). It begins with steps 1 to 6: fingerprints, one text of each,
pivot distances, links of up to two bits. The exact Jaccard similarity of the
shingle sets verifies them, and they give the first groups. Other similar texts have fingerprints
that differ in ten bits and more, which no split into blocks can bucket; these
come, across groups only, from min-wise sketches of the same shingle hashes and
are verified alike. Fingerprints do not
discard any: they count repeated shingles, which the sets do not. Buckets of up to
``pair_limit`` texts give all their pairs. In crowded ones every member is first
compared with ``n_centres`` of them, other ones in every band, then with the
member that has most links, so a group of thousands of near copies gives tens of
candidates a copy and not all pairs. What is still in unlike groups of one
crowded bucket is then compared in full, in cells of two blocks of ``block``
texts, so no similar pair that shares a bucket stays apart.

Nulls: a null text counts as empty. A text without words has fingerprint zero,
which links like any other. Rows repeat in the result as often as in the input.
A null id never becomes a group's id unless all ids of the group are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.batches import small_batches
from latticework.llm.components import connected_components
from latticework.llm.scratch import materialize

SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every ``width``-word shingle of the A-Z-lowered text, repeats included."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    starts = [0, *ends]
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes; signed 64-bit."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(id_col, fp long)``, one row per input row."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values = [simhash(shingle_hashes(t.as_py(), shingle_words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def pivots(count: int) -> list[int]:
    """Reference fingerprints: the zero word and ``count - 1`` hashed ones, signed."""
    words = [0, *(xxhash.xxh64_intdigest(str(i), SEED) for i in range(1, count))]
    return [w - (1 << 64) if w >= 1 << 63 else w for w in words]


def pivot_table(fps: DataFrame, n_pivots: int = 16) -> DataFrame:
    """``fps`` with ``coords``: the Hamming distance to each pivot."""
    coords = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p).cast("long"))).cast("byte") for p in pivots(n_pivots)])
    return fps.withColumn("coords", coords)


def _within(a: str, b: str, max_bits: int) -> Column:
    gap = F.array_max(F.zip_with(F.col(f"{a}.coords"), F.col(f"{b}.coords"), lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    return gap <= max_bits


def _buckets(table: DataFrame, max_bits: int) -> DataFrame:
    blocks = max_bits + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    both = [masks[i] | masks[j] for i, j in combinations(range(blocks), 2)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in both]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    return table.select("fp", "coords", F.explode(keys).alias("k")).select("fp", "coords", "k.part", "k.key")


def links(fps: DataFrame, max_bits: int = 2, n_pivots: int = 16, bucket_limit: int = 128) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints of ``fps(fp)`` whose components are those of all links.

    Pairs from crowded buckets are given through a shared midpoint's smallest
    neighbour, so their edges connect what the links connect without listing
    every pair; all other links are listed one by one.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the midpoint way for crowded buckets covers max_bits 0 to 2")
    table = pivot_table(fps.select("fp").where("fp IS NOT NULL").distinct(), n_pivots)
    rows = materialize(_buckets(table, max_bits), "simhash-buckets")
    # stored, as other tables of one row a bucket: AQE splits a join with a crowded bucket only if both sides are plain
    shared = materialize(rows.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shared")
    members = materialize(rows.join(shared, ["part", "key"]), "simhash-members")
    light = members.where(F.col("n") <= bucket_limit)
    a, b = light.alias("a"), light.alias("b")
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    paired = (
        a.join(b, same)
        .where(_within("a", "b", max_bits))
        .where(exact)
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    crowded = members.where(F.col("n") > bucket_limit).select("fp").distinct()
    return paired.unionByName(_midpoint_links(crowded, max_bits)).distinct()


def _midpoint_links(crowded: DataFrame, max_bits: int) -> DataFrame:
    flips = [1 << i for i in range(64)]
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in flips])
    near = crowded.select("fp", F.explode(ball).alias("mid")) if max_bits == 2 else None
    if near is None:
        # one bit apart: one of the two is itself the other's flipped value
        flipped = F.array(*[F.col("fp").bitwiseXOR(F.lit(f).cast("long")) for f in flips])
        other = crowded.select(F.col("fp").alias("dst"))
        pairs = crowded.select(F.col("fp").alias("src"), F.explode(flipped).alias("dst")).join(other, "dst")
        return pairs.where((F.col("src") < F.col("dst")) & F.lit(max_bits == 1)).select("src", "dst")
    least = near.groupBy("mid").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).where("n > 1")
    return near.join(least.select("mid", "dst"), "mid").where("fp <> dst").select(F.col("fp").alias("src"), "dst")


def near_duplicate_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bits: int = 2,
    n_pivots: int = 16,
    bucket_limit: int = 128,
) -> DataFrame:
    """``(id_col, fp, component_id)``: the smallest id reachable over links of ``max_bits`` or fewer bits."""
    hashed = materialize(fingerprints(docs, id_col, text_col, shingle_words), "simhash-fp")
    distinct = materialize(hashed.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-distinct")
    edges = links(distinct, max_bits, n_pivots, bucket_limit)
    parts = materialize(
        connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root")), "simhash-parts"
    )
    smallest = parts.join(distinct, "fp").groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = parts.join(smallest, "root").select("fp", "component_id")
    classes = materialize(
        distinct.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")),
        "simhash-classes",
    )
    return hashed.join(classes, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


BANDS, ROWS = 20, 4
_BINS = BANDS * ROWS


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key per band of a one-permutation min-wise sketch; 0 where a band is empty.

    Two texts agree in a band if the smallest hash of each of its bins agrees,
    so of texts with similarity 0.8 some 99.99 % share a band.
    """
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    ordered = np.unique((hashes * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF))
    edges = np.array([(i << 64) // _BINS for i in range(_BINS)], np.uint64)
    first = np.searchsorted(ordered, edges)
    last = np.append(first[1:], len(ordered))
    least = np.where(first < last, ordered[np.minimum(first, len(ordered) - 1)], 0).astype(">u8").reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) or 1 if row.any() else 0 for band, row in enumerate(least)]
    return np.array(keys, np.uint64).view(np.int64)


def _node(text: Column) -> Column:
    """128 bits of a text: the identity of exact copies."""
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text)))


def _sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(node, fp, bands) of ``docs(node, t binary)``: fingerprint and sketch of the same shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hashes = [shingle_hashes(text.as_py(), shingle_words) for text in batch.column(1)]
            fps, bands = pa.array([simhash(h) for h in hashes], pa.int64()), pa.array([band_keys(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, bands], names=["node", "fp", "bands"])

    return docs.mapInArrow(run, "node string, fp long, bands array<long>")


def fingerprint_pairs(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(src, dst): nodes of ``fps(node, fp)`` whose fingerprints link, by ``links``.

    Nodes of one fingerprint are paired with the smallest of them, which stands for it in links to others.
    """
    first = materialize(fps.groupBy("fp").agg(F.min("node").alias("first")), "similar-first")
    same = fps.join(first, "fp").where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node"))
    linked = links(first, max_bits).join(of("src"), "src").join(of("dst"), "dst")
    near = linked.select(F.greatest("src_node", "dst_node").alias("src"), F.least("src_node", "dst_node").alias("dst"))
    return same.unionByName(near).distinct()


def _shingle_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles array<int>) of ``docs(node, t binary)``: the set of 32-bit shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), shingle_words) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node string, shingles array<int>")


def _candidates(members: DataFrame, pair_limit: int, n_centres: int) -> DataFrame:
    """(src, dst): pairs of unlike ``group``: all of small buckets; in crowded ones each member with each of the centres.

    The first centre is the most copied text of the bucket, the others follow
    from hashes that differ by band, so a text meets other centres in every band.
    """
    bucket, meet = ["band", "key"], [F.col("a.band") == F.col("b.band"), F.col("a.key") == F.col("b.key")]
    small, crowded = members.where(F.col("n") <= pair_limit), members.where(F.col("n") > pair_limit)
    both = small.alias("a").join(small.alias("b"), [*meet, F.col("a.node") > F.col("b.node"), F.col("a.group") != F.col("b.group")])
    one = F.struct("node", "group")
    first = F.max_by(one, F.struct("copies", F.xxhash64("node"))).alias("c0")
    others = [F.min_by(one, F.xxhash64("node", "band", F.lit(i))).alias(f"c{i}") for i in range(1, n_centres)]
    chosen = materialize(crowded.groupBy(*bucket).agg(first, *others), "similar-centres")
    centres = chosen.select(*bucket, F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(n_centres)]))).alias("c")).select(*bucket, "c.*")
    star = crowded.alias("a").join(centres.alias("b"), [*meet, F.col("a.group") != F.col("b.group")])
    pairs = both.select("a.node", F.col("b.node").alias("other")).unionByName(star.select("a.node", F.col("b.node").alias("other")))
    return pairs.select(F.greatest("node", "other").alias("src"), F.least("node", "other").alias("dst")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose ``sets(node, shingles)`` have a Jaccard similarity of ``similarity`` or more."""
    a, b = sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    near = shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)
    return materialize(pairs.join(a, "src").join(b, "dst").where(near).select("src", "dst"), "similar-links")


def _unsettled(crowded: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``crowded(band, key, node)`` whose bucket holds unlike groups, with group, and the bucket's largest group ``top``.

    ``linked`` is the number of members in the largest group, ``loose`` that of all others.
    """
    named = materialize(crowded.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")), "similar-named")
    sizes = named.groupBy("band", "key", "group").agg(F.count("*").alias("m"))
    top = F.max_by("group", F.struct("m", "group")).alias("top")
    tops = sizes.groupBy("band", "key").agg(top, F.max("m").alias("linked"), (F.sum("m") - F.max("m")).alias("loose")).where("loose > 0")
    return materialize(named.join(materialize(tops, "similar-tops"), ["band", "key"]), "similar-unsettled")


def _hub_pairs(unsettled: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): the members of each bucket with the one of them that has most links, where groups differ."""
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node")))
    known = unsettled.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node")
    hub = F.max_by(F.struct("node", "group"), F.struct("degree", "node")).alias("hub")
    hubs = materialize(known.groupBy("band", "key").agg(hub), "similar-hub-of")
    met = unsettled.join(hubs, ["band", "key"]).where(F.col("group") != F.col("hub.group"))
    return met.select(F.greatest("node", "hub.node").alias("src"), F.least("node", "hub.node").alias("dst")).distinct()


def _cell_links(table: pa.Table, similarity: float) -> pa.Table:
    """(src, dst): links that join the groups of one cell as all its similar pairs of unlike groups do."""
    nodes, (names, group) = table.column("node").to_pylist(), np.unique(table.column("group").to_numpy(), return_inverse=True)
    at, first, second = (table.column(c).to_numpy() for c in ("at", "i", "j"))
    sets = table.column("shingles").combine_chunks()
    sizes = pc.list_value_length(sets).to_numpy()
    owner = np.repeat(np.arange(len(nodes)), sizes)
    _, code, held = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # a shingle of one text alone is in no intersection
    column = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[code]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    a, b = np.flatnonzero(at == first), np.flatnonzero(at == second)
    shared, width = np.zeros((len(a), len(b))), 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        has = np.zeros((len(nodes), width), np.float32)
        has[owner[part], column[part] - low] = 1
        shared += has[a] @ has[b].T
    near = (shared >= similarity * (sizes[a][:, None] + sizes[b] - shared)) & (group[a][:, None] != group[b])
    rows, columns = np.nonzero(near)
    parent, out = list(range(len(names))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a[rows].tolist(), b[columns].tolist(), strict=True):
        p, q = root(int(group[x])), root(int(group[y]))
        if p != q:
            parent[p] = q
            out.append((nodes[x], nodes[y]))
    return pa.table({"src": pa.array([x for x, _ in out], pa.string()), "dst": pa.array([y for _, y in out], pa.string())})


def _all_pairs(unsettled: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """(src, dst): links that join what similar pairs of unlike groups in one bucket join, from comparing all of them.

    Members outside a bucket's largest group lie in blocks 0 to ``open`` - 1, those of the
    largest in the blocks after; a cell is two blocks, at least one of them open.
    """
    n_open, n_all = F.ceil(F.col("loose") / block), F.ceil(F.col("loose") / block) + F.ceil(F.col("linked") / block)
    spread, is_open = F.xxhash64("node", "band"), F.col("group") != F.col("top")
    at = F.when(is_open, F.pmod(spread, n_open)).otherwise(n_open + F.pmod(spread, n_all - n_open))
    placed = unsettled.select("band", "key", "node", "group", at.alias("at"), F.when(is_open, n_all).otherwise(n_open).alias("meets"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("meets") - 1), lambda i: F.struct(F.least(i, "at").alias("i"), F.greatest(i, "at").alias("j")))
    dealt = placed.select("band", "key", "node", "group", "at", F.explode(cells).alias("c")).select("band", "key", "c.i", "c.j", "at", "node", "group")
    run = lambda table: _cell_links(table, similarity)
    found = dealt.join(sets, "node").groupBy("band", "key", "i", "j").applyInArrow(run, "src string, dst string")
    return materialize(found, "similar-rest")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups(node, group)`` after ``links(src, dst)`` between nodes, which may be in no group yet."""
    ends = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    known = materialize(groups.unionByName(ends.join(groups, "node", "left_anti").withColumn("group", F.col("node"))), "similar-known")
    of = lambda end: known.select(F.col("node").alias(end), F.col("group").alias(f"{end}_group"))
    between = links.join(of("src"), "src").join(of("dst"), "dst").select(F.col("src_group").alias("src"), F.col("dst_group").alias("dst"))
    joined = connected_components(between).select(F.col("node").alias("group"), "component")
    return materialize(known.join(joined, "group", "left").select("node", F.coalesce("component", "group").alias("group")), "similar-merged")


def _named(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the group that ``links`` put each node in, or its own."""
    groups = connected_components(links).withColumnRenamed("component", "group")
    return members.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))


def similar_groups(
    docs: DataFrame, text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8,
    first_bands: int = 4, pair_limit: int = 16, n_centres: int = 8, block: int = 128,
) -> DataFrame:
    """(node, group): each distinct text that has similar ones, and the group it belongs to.

    Links of fingerprints come first, then the first bands; each is verified and grouped
    before the next, which then need only be compared across groups. Crowded buckets that hold unlike groups even
    then are compared with their hubs, and what is left of them in full.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(_node(text).alias("node"), text.cast("binary").alias("t"))
    sketches = materialize(_sketches(texts, shingle_words), "similar-sketches")
    distinct = sketches.groupBy("node").agg(F.count("*").alias("copies"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
    hashed = materialize(distinct.select("node", "fp"), "similar-fps")
    linked = materialize(fingerprint_pairs(hashed), "similar-linked")
    rows = distinct.select("node", "copies", F.posexplode("bands").alias("band", "key")).where("key <> 0")
    shared = materialize(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "similar-shared")
    members = materialize(rows.join(shared, ["band", "key"]), "similar-members")
    # one shuffle of the distinct texts: copies meet on the map side, then those in no shared bucket go
    asked = members.select("node").union(linked.select("src")).union(linked.select("dst")).distinct()
    own = texts.groupBy("node").agg(F.min("t").alias("t")).join(asked, "node", "left_semi")
    sets = materialize(_shingle_sets(own, shingle_words), "similar-sets")
    links_0 = _verified(linked, sets, similarity)
    first = materialize(_named(members, links_0), "similar-named")
    early = materialize(_candidates(first.where(F.col("band") < first_bands), pair_limit, 2), "similar-early")
    links_1 = links_0.unionByName(_verified(early, sets, similarity))
    grouped = materialize(_named(members, links_1), "similar-grouped")
    late = _candidates(grouped, pair_limit, n_centres).join(early, ["src", "dst"], "left_anti")
    links_2 = _verified(materialize(late, "similar-late"), sets, similarity)
    links = links_1.unionByName(links_2)
    every = materialize(connected_components(links).select("node", F.col("component").alias("group")), "similar-every")
    crowded = members.where(F.col("n") > pair_limit).select("band", "key", "node")
    apart = _unsettled(crowded, every)
    if apart.isEmpty():
        return every
    every = _merged(every, _verified(materialize(_hub_pairs(apart, links), "similar-hubs"), sets, similarity))
    apart = _unsettled(apart.select("band", "key", "node"), every)
    return every if apart.isEmpty() else _merged(every, _all_pairs(apart, sets, similarity, block))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of similar texts the row with the smallest id.

    Null ids come last. Of rows with one id and one text one is kept, the same in every run,
    whatever their other columns hold.
    """
    groups = similar_groups(docs, text_col, **how)
    node = _node(F.coalesce(F.col(text_col), F.lit("")))
    ids = docs.select(F.col(id_col).alias("_id"), node.alias("node"))
    least = ids.groupBy("node").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id")).alias("least"))
    named = least.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    best = named.groupBy("group").agg(F.min(F.struct("least", "node")).alias("k"))
    # one text key for node and id: join and grouping share a partitioning, so rows are shuffled once
    place = lambda at, ident: F.concat_ws("/", at, F.coalesce(ident.cast("string"), F.lit("-")))
    kept = materialize(best.select(place(F.col("k.node"), F.col("k.least._id")).alias("_place")), "similar-kept")
    hashed = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in ((f"`{n}`", k) for n, k in docs.dtypes) if c != f"`{text_col}`"]
    whole = docs.select(F.struct("*").alias("_row"), place(node, F.col(id_col)).alias("_place"), F.xxhash64(*hashed).alias("_order"))
    return whole.join(kept, "_place").groupBy("_place").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
