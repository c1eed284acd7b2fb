"""Search by blocks: edges in a grid of P x P cells, frontier and visited as packed bitmaps.

Cell (row_b, col_b) holds the edges from vertex block col_b into vertex block row_b.
Inside a column of cells edges are told apart by the page of their source, a range of
``PAGE`` vertices, and a crowded cell is dealt to several segments, so a hub's column
lies in P rows of cells and no segment holds more than about ``segment`` edges. A
segment is one row with two integer arrays. Segments are written once, in buckets,
and never move again.

A bitmap is a table of pages of 4096 bytes, one bit a vertex. A round sends the pages of the
frontier down their columns, to the segments that start in them; tests the source's
bit of every edge there and sets the target's in pages of the task's own; reduces these
pages by OR along the rows, combined on the map side; and masks what is new word by
word with what is visited. What is shuffled are pages: n / 8 bytes a row of cells at
most, however many edges there are, and nothing for pages without a frontier bit.

A round is one job. Its state, one row a page, is written, so the loss of an executor
costs a re-read. Levels are read off the rounds' pages at the end, and parents follow
in one pass over the edges.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latticework.operators.blocks import block_edge
from latticework.operators.search import with_parents
from latticework.plans.tables import discard, kept_until_exit, new_path, stored

#: Bits of a page, as many as Spark's own bitmaps have.
PAGE = 32768
BYTES = PAGE // 8
#: Pages that a task holds before it hands them on.
HELD_PAGES = 4096
#: Edges that a task packs before it drops their repeats.
HELD_EDGES = 1 << 20
_KEY = ["row_b", "col_b", "page", "seg"]
_KEY_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
_STATE = "page bigint, frontier binary, visited binary, nf bigint"


@dataclass
class Cells:
    """A graph in cells: ``segments(row_b, col_b, page, seg, src_l, dst)`` in buckets, and the segments there are of each cell and page."""

    segments: DataFrame
    counts: DataFrame
    n: int
    grid: int
    name: str

    def edges(self) -> DataFrame:
        each = self.segments.select("page", F.explode(F.arrays_zip("src_l", "dst")).alias("e"))
        return each.select((F.col("page") * PAGE + F.col("e.src_l")).alias("src"), F.col("e.dst").alias("dst"))

    def release(self) -> None:
        discard(self.segments)
        discard(self.counts)
        self.segments.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _packer(n: int, radix: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per key of rows (key, edge) that come with equal keys together; an edge counts once.

    ``key`` is the four columns of a segment's key as digits of one number, those after the first below ``radix``;
    ``edge`` is src_l * n + dst.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], 0

        def handed() -> pa.RecordBatch:
            own, digits, rest = np.unique(np.concatenate(held)), [], key
            for base in reversed(radix):
                rest, digit = divmod(rest, base)
                digits.insert(0, digit)
            ends = pa.array([0, len(own)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array((own // n).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(own % n))]
            return pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip([rest, *digits], _KEY_TYPES, strict=True)], *lists], names=[*_KEY, "src_l", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, edges = batch["key"].to_numpy(), batch["edge"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if (own := int(keys[begin])) != key:
                    if key is not None:
                        yield handed()
                    key, held, rows = own, [], 0
                held.append(edges[begin:end])
                rows += end - begin
                if rows > HELD_EDGES:  # repeats of an edge do not pile up
                    held, rows = [np.unique(np.concatenate(held))], 0
        if key is not None:
            yield handed()

    return pack


def build_cells(edges: DataFrame, n: int, grid: int, segment: int = 65_536, buckets: int | None = None) -> Cells:
    """Distinct ``edges(src, dst)`` with ids from 0 to n - 1, packed into the segments of a grid of cells.

    ``edges`` are read twice, to count and to deal them, so they had better be stored. They are shuffled
    once, to their segments; repeats of an edge meet there.
    """
    spark = edges.sparkSession
    size = block_edge(max(1, n), grid)
    placed = edges.select(F.expr(f"dst div {size}").alias("row_b"), F.expr(f"src div {size}").alias("col_b"), F.expr(f"src div {PAGE}").alias("page"), "src", "dst")
    sizes = placed.groupBy("row_b", "col_b", "page").agg(F.count("*").alias("nnz"))
    counts = stored(sizes.select("row_b", "col_b", "page", F.ceil(F.col("nnz") / segment).cast("int").alias("segs"), "nnz"), "grid-counts")
    seg = F.pmod(F.xxhash64("src", "dst"), F.col("segs")).cast("int").alias("seg")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a segment's key as one number and an edge as another: what is shuffled, sorted and packed are two longs
    pages, most = n // PAGE + 1, counts.agg(F.max("segs")).first()[0] or 1
    number = ((F.col("row_b") * grid + F.col("col_b")) * pages + F.col("page")) * most + seg
    edge = F.col("src") % PAGE * max(1, n) + F.col("dst")
    dealt = placed.join(counts, ["row_b", "col_b", "page"]).select(number.alias("key"), edge.alias("edge"))
    # by the values that the buckets are made of, so each bucket is one task's
    parts = [f"key div {most * pages * grid}", f"key div {most * pages} % {grid}", f"key div {most} % {pages}", f"CAST(key % {most} AS INT)"]
    together = dealt.repartition(buckets, *[F.expr(x) for x in parts]).sortWithinPartitions("key")
    packed = together.mapInArrow(_packer(max(1, n), [grid, pages, most]), "row_b bigint, col_b bigint, page bigint, seg int, src_l array<int>, dst array<bigint>")
    path = new_path(spark, "grid-cells")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    packed.write.bucketBy(buckets, *_KEY).option("path", path).saveAsTable(name)
    kept_until_exit(spark, path)
    return Cells(spark.table(name), counts, n, grid, name)


def bitmap_pages(vertices: DataFrame) -> DataFrame:
    """(page, bits) of ``vertices(vertex)``: one bit each, in pages."""
    return vertices.groupBy(F.expr(f"vertex div {PAGE}").alias("page")).agg(F.bitmap_construct_agg(F.col("vertex") % PAGE).alias("bits"))


def page_vertices(pages: DataFrame) -> DataFrame:
    """The vertices of ``pages(page, bits, ...)``, with its other columns."""
    others = [c for c in pages.columns if c not in ("page", "bits")]
    schema = pa.schema([pa.field("vertex", pa.int64()), *_arrow_fields(pages.select(*others))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = np.flatnonzero(_bits(batch["bits"][i].as_py())) + batch["page"][i].as_py() * PAGE
                repeated = [pa.array(np.repeat(batch[c][i : i + 1].to_numpy(zero_copy_only=False), len(at)), schema.field(c).type) for c in others]
                yield pa.RecordBatch.from_arrays([pa.array(at), *repeated], schema=schema)

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(unpack, ", ".join(["vertex bigint", *[f"{c} {kinds[c]}" for c in others]]))


def _arrow_fields(rows: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(rows.schema))


def _bits(page: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(page, np.uint8), bitorder="little")


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with the targets of the edges whose source is in the frontier, combined over the task's segments."""
    held: dict[int, np.ndarray] = {}

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"page": pa.array(list(held), pa.int64()), "bits": pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())})

    for batch in batches:
        for page_bits, src, dst in zip(batch["bits"], batch["src_l"], batch["dst"], strict=True):
            asked = _bits(page_bits.as_py())
            reached = dst.values.to_numpy()[asked[src.values.to_numpy()] > 0]
            pages = reached // PAGE
            for page in np.unique(pages):
                if page not in held:
                    held[int(page)] = np.zeros(PAGE, np.uint8)
                held[int(page)][reached[pages == page] % PAGE] = 1
        if len(held) >= HELD_PAGES:
            yield handed()
            held.clear()
    yield handed()


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next state of each page: candidates without what is visited, and both together."""
    empty = bytes(BYTES)
    for batch in batches:
        found = [np.frombuffer(x or empty, np.uint64) for x in batch["found"].to_pylist()]
        before = [np.frombuffer(x or empty, np.uint64) for x in batch["visited"].to_pylist()]
        new = [f & ~b for f, b in zip(found, before, strict=True)]
        yield pa.RecordBatch.from_pydict({
            "page": batch["page"],
            "frontier": pa.array([x.tobytes() for x in new], pa.binary()),
            "visited": pa.array([(x | b).tobytes() for x, b in zip(new, before, strict=True)], pa.binary()),
            "nf": pa.array([int(np.bitwise_count(x).sum()) for x in new], pa.int64()),
        })


def candidates(cells: Cells, frontier: DataFrame) -> DataFrame:
    """(page, bits): the OR over all cells of what ``frontier(page, bits)`` reaches in each."""
    sent = frontier.join(cells.counts, "page").select("row_b", "col_b", "page", F.explode(F.sequence(F.lit(0), F.col("segs") - 1)).alias("seg"), "bits")
    met = cells.segments.join(sent, _KEY).select("bits", "src_l", "dst")
    return met.mapInArrow(_expand, "page bigint, bits binary").groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def step(cells: Cells, state: DataFrame) -> DataFrame:
    """The state after one more round: ``state(page, frontier, visited, nf)``."""
    frontier = state.where("nf > 0").select("page", F.col("frontier").alias("bits"))
    found = candidates(cells, frontier).withColumnRenamed("bits", "found")
    return state.select("page", "visited").join(found, "page", "full").select("page", "found", "visited").mapInArrow(_mask, _STATE)


@dataclass
class GridSearch:
    """The rounds of a search: ``pages(level, page, bits)``, and (round, nf, started, ended) of each round, the last with nf 0."""

    pages: DataFrame
    rounds: list[tuple[int, int, float, float]]


def search_cells(cells: Cells, root: int) -> GridSearch:
    """Rounds from ``root`` until one finds nothing."""
    spark: SparkSession = cells.segments.sparkSession
    first = bitmap_pages(spark.createDataFrame([(root,)], "vertex bigint"))
    states, rounds = [stored(first.select("page", F.col("bits").alias("frontier"), F.col("bits").alias("visited"), F.lit(1).cast("bigint").alias("nf")), "grid-state")], []
    while True:
        began, told = time.time(), Observation()
        made = step(cells, states[-1]).observe(told, F.sum("nf").alias("nf"))
        states.append(stored(made, "grid-state"))
        nf = told.get.get("nf") or 0
        rounds.append((len(rounds), nf, began, time.time()))
        if not nf:
            break
    levels = [s.where("nf > 0").select(F.lit(level).cast("int").alias("level"), "page", F.col("frontier").alias("bits")) for level, s in enumerate(states[:-1])]
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    pages = stored(every, "grid-levels")
    for state in states:
        discard(state)
    return GridSearch(pages, rounds)


def bfs_grid(cells: Cells, root: int) -> DataFrame:
    """(source, vertex, level, parent), as ``search.bfs`` gives them, with every round over the cells."""
    levels = page_vertices(search_cells(cells, root).pages).select(F.lit(root).cast("bigint").alias("source"), "vertex", "level")
    return with_parents(stored(levels, "grid-result"), cells.edges())
