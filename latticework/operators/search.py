"""Level-synchronous breadth-first search over edge tables.

A round meets the out-edges of the frontier, keeps the smallest predecessor of each
vertex reached, and drops what was visited before. Up to 64 searches run as one:
every vertex row holds a long with one bit per root, so an edge is met once for
all roots of a batch, and parents are one conditional minimum per root.

``build`` makes the table that searches run on: distinct edges, written to the
shared folder in buckets by src. The levels of a search are written in buckets by
vertex, as many as the edges have. So the frontier meets its edges, and candidates
meet what is visited, where they lie: a top-down round shuffles its candidates, one
row per vertex and task, and nothing else. Bottom-up rounds read the mirror, the
same edges in buckets by dst (for a symmetric graph the same files), beside what is
visited; the rows of the frontier come to them, by broadcast where their number is
known to be at most ``broadcast_rows``, else by a shuffle join. Each root turns
by its own rounds. Edges of a vertex with more than ``hub_degree`` of them are dealt
to several buckets, and the hub's row to each of them, so no task holds a hub.

A round is one job: its counts are observed while it writes, and its times taken
around it. After a frontier of at most ``THIN`` rows the next level goes to a file of
its own, and ``STRIDE`` of them to the buckets at a time, so long thin graphs do not
pay for buckets a level; the rows are the same. Every round is written, which cuts
the lineage: the loss of an executor costs a re-read.

The parent is the smallest frontier predecessor, the root's parent is itself.
``rounds`` counts the last, empty round; ``nf`` has one entry per round.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from latticework.operators.edges import with_global_rank
from latticework.plans.tables import discard, kept_until_exit, new_path, stored

RESULT = "source bigint, vertex bigint, level int, parent bigint"
ROUNDS = "source bigint, round int, nf bigint, direction string, started double, ended double"
#: Roots of a batch, one bit each.
BATCH = 64
THIN, STRIDE = 20_000, 8
BROADCAST_ROWS = 2_000_000


@dataclass
class Side:
    """Edges in buckets by one end (and part), and the number of parts of each hub among these ends (None: no hubs)."""

    edges: DataFrame
    key: str
    hubs: DataFrame | None
    name: str = ""

    def release(self) -> None:
        if self.name:
            discard(self.edges)
            self.edges.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.hubs is not None:
            discard(self.hubs)

    def beside(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """``rows`` under the name of the key, one for each part of a hub, and the columns to join the edges on."""
        if self.hubs is None:
            return rows, [self.key]
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        return rows.join(self.hubs, self.key, "left").select(*rows.columns, parts), [self.key, "part"]


def _side(edges: DataFrame, key: str, other: str, hub_degree: int, buckets: int, distinct: bool = False) -> Side:
    """Distinct ``edges`` in buckets by ``key``. The input is read once; it is dealt anew only where there are hubs."""
    spark = edges.sparkSession

    def written(dealt: DataFrame, keys: list[str], distinct: bool) -> tuple[DataFrame, str]:
        path = new_path(spark, "bfs-edges")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        # repeats of an edge share its bucket: the deal to buckets is the only shuffle
        placed = dealt.repartition(buckets, *keys)
        # not sorted inside a bucket: joins do not count on it, and the sort would compare whole rows
        (placed if distinct else placed.distinct()).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
        kept_until_exit(spark, path)
        return spark.table(name), name

    table, name = written(edges.select("src", "dst", F.lit(0).alias("part")), [key], distinct)
    large = table.groupBy(key).agg(F.count("*").alias("degree")).where(F.col("degree") > hub_degree)
    hubs = stored(large.select(key, F.ceil(F.col("degree") / hub_degree).cast("int").alias("parts")), "bfs-hubs")
    if hubs.isEmpty():
        discard(hubs)
        return Side(table, key, None, name)
    part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    parted, parted_name = written(table.select("src", "dst").join(hubs, key, "left").select("src", "dst", part), [key, "part"], True)
    Side(table, key, None, name).release()
    return Side(parted, key, hubs, parted_name)


@dataclass
class Built:
    """A graph ready for searches: its edges by source, and by destination once that is asked for."""

    out: Side
    buckets: int
    hub_degree: int
    mirror: Side | None = None

    @property
    def edges(self) -> DataFrame:
        return self.out.edges

    @property
    def hubs(self) -> DataFrame | None:
        return self.out.hubs

    def into(self, symmetric: bool) -> Side:
        """The edges by destination; those of a symmetric graph are its edges by source with the ends' names exchanged."""
        if symmetric:
            turned = self.out.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "part")
            hubs = self.out.hubs
            return Side(turned, "dst", None if hubs is None else hubs.withColumnRenamed("src", "dst"))
        if self.mirror is None:
            self.mirror = _side(self.out.edges.select("src", "dst"), "dst", "src", self.hub_degree, self.buckets, True)
        return self.mirror

    def release(self) -> None:
        """Drop the tables and their files; nothing that a search returned reads them."""
        self.out.release()
        if self.mirror is not None:
            self.mirror.release()


def build(edges: DataFrame, hub_degree: int = 1_000_000, buckets: int | None = None, distinct: bool = False) -> Built:
    """Distinct ``edges(src, dst)`` in buckets by src, hubs in parts of about ``hub_degree`` edges. ``distinct``: they are so already."""
    n = buckets or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Built(_side(edges, "src", "dst", hub_degree, n, distinct), n, hub_degree)


def expand_topdown(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(source, vertex, parent): the best predecessor of every vertex one step from ``frontier(source, vertex)``."""
    met = frontier.select("source", F.col("vertex").alias("src")).join(edges, "src")
    return met.groupBy("source", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))


def expand_bottomup(edges: DataFrame, frontier: DataFrame, visited: DataFrame, n_sources: int = 1) -> DataFrame:
    """The same rows for unvisited vertices, found from their in-edges.

    ``visited(source, vertex)`` is distinct. An edge is open while its dst is unvisited by any of the
    ``n_sources`` sources that take part; what one of them has visited is dropped for that source.
    """
    took_part = visited.join(frontier.select("source").distinct(), "source", "left_semi")
    closed = took_part.groupBy(F.col("vertex").alias("dst")).agg(F.count("*").alias("n")).where(F.col("n") >= n_sources).select("dst")
    return frontier_new(expand_topdown(edges.join(closed, "dst", "left_anti"), frontier), visited)


def frontier_new(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    """Candidates not visited before."""
    return candidates.join(visited.select("source", "vertex"), ["source", "vertex"], "left_anti")


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << 64) * (i == 63)).cast("bigint")


def _mask(which: Sequence[int]) -> Column:
    value = sum(1 << i for i in which)
    return F.lit(value - (1 << 64) * (value >> 63)).cast("bigint")


def _has(bits: Column, i: int) -> Column:
    return bits.bitwiseAND(_bit(i)) != 0


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


class _Search:
    """Searches from a batch of roots, round by round.

    ``levels(vertex, bits, p0, p1, ..., level)`` has a row for each vertex and level at which some
    root reaches it: bit i and the parent pi for the i-th root.
    """

    def __init__(self, graph: Built, roots: Sequence[int], symmetric: bool, switch_at: float | None, broadcast_rows: int):
        self.graph, self.roots, self.symmetric, self.switch_at, self.broadcast_rows = graph, roots, symmetric, switch_at, broadcast_rows
        self.spark = graph.edges.sparkSession
        self.k = len(roots)
        self.parents = [f"p{i}" for i in range(self.k)]
        self.stored_to = -1  # the last level in buckets; those after it are held in files of their own
        self.path = new_path(self.spark, "bfs-levels")
        self.name = self.path.rsplit("/", 1)[1].replace("-", "_")
        self.turned: list[int] = []
        self.rounds: list[tuple] = []
        first = [(r, (1 << i) - (1 << 64) * (i == 63), *[r if j == i else None for j in range(self.k)], 0) for i, r in enumerate(roots)]
        schema = f"vertex bigint, bits bigint, {', '.join(f'{p} bigint' for p in self.parents)}, level int"
        self.held = [self.spark.createDataFrame(first, schema)]

    def _append(self, number: int, rows: DataFrame) -> None:
        """Put the held levels and ``rows``, up to level ``number``, into the buckets."""
        _union([*self.held, rows]).write.mode("append").partitionBy("level").bucketBy(self.graph.buckets, "vertex").option("path", self.path).saveAsTable(self.name)
        if self.stored_to < 0:
            kept_until_exit(self.spark, self.path)
        for table in self.held:
            discard(table)
        self.held, self.stored_to = [], number

    @property
    def levels(self) -> DataFrame:
        return self.spark.table(self.name)

    def met_topdown(self, frontier: DataFrame) -> DataFrame:
        """(src, bits, level, dst): the out-edges of ``frontier(src, bits, level)``."""
        asked, on = self.graph.out.beside(frontier)
        return asked.join(self.graph.edges, on).select("src", "bits", "level", "dst")

    def met_bottomup(self, frontier: DataFrame, visited: list[DataFrame], rows: int) -> DataFrame:
        """(src, bits, level, dst): the edges from ``frontier(src, bits, level)`` into vertices that some of the turned roots have not seen."""
        side = self.graph.into(self.symmetric)
        edges = side.edges.withColumn("open", _mask(self.turned))
        for i, table in enumerate(visited):
            beside, on = side.beside(self._seen(table, i).withColumnRenamed("vertex", "dst"))
            edges = edges.join(beside, on, "left").withColumn("open", self._without("open", i))
        edges = edges.where("open <> 0").select("src", "dst")
        return edges.join(F.broadcast(frontier) if rows <= self.broadcast_rows else frontier, "src").select("src", "bits", "level", "dst")

    def _best(self, met: DataFrame) -> DataFrame:
        """One row per vertex: who reaches it, and each root's smallest predecessor."""
        least = [F.min(F.when(_has(F.col("bits"), i), F.col("src"))).alias(p) for i, p in enumerate(self.parents)]
        # the level comes with the rows: a number that differs by round would have Spark compile every round anew
        return met.groupBy(F.col("dst").alias("vertex")).agg(F.bit_or("bits").alias("bits"), (F.max("level") + 1).alias("level"), *least)

    @staticmethod
    def _seen(table: DataFrame, i: int) -> DataFrame:
        return table.groupBy("vertex").agg(F.bit_or("bits").alias(f"seen{i}"))

    @staticmethod
    def _without(bits: str, i: int) -> Column:
        return F.col(bits).bitwiseAND(F.bitwise_not(F.coalesce(f"seen{i}", F.lit(0).cast("bigint"))))

    def _new(self, rows: DataFrame, visited: list[DataFrame]) -> DataFrame:
        """Candidates for the roots that have not visited them. Each table of ``visited`` is met where it lies."""
        for i, table in enumerate(visited):
            rows = rows.join(self._seen(table, i), "vertex", "left").withColumn("bits", self._without("bits", i))
        own = [F.when(_has(F.col("bits"), i), F.col(p)).alias(p) for i, p in enumerate(self.parents)]
        return rows.where("bits <> 0").select("vertex", "bits", *own, "level")

    def _visited(self, number: int, all_levels: bool) -> list[DataFrame]:
        """The levels that rows of level ``number`` may lie on: those in buckets, and those held."""
        # neighbours of a level of a symmetric graph lie at most one level back
        low = 0 if all_levels or not self.symmetric else number - 2
        held = self.held[-2:] if low else self.held
        stored_ones = [] if self.stored_to < max(low, 0) else [self.levels.where(F.col("level") >= low) if low else self.levels]
        return [*stored_ones, *([_union(held)] if held else [])]

    def found(self, number: int, rows: int) -> DataFrame:
        """The rows of level ``number``, where the level before has ``rows``."""
        frontier = self.held[-1] if self.held else self.levels.where(F.col("level") == number - 1)
        asked = frontier.select(F.col("vertex").alias("src"), "bits", "level")
        if not self.turned:
            return self._new(self._best(self.met_topdown(asked)), self._visited(number, False))
        visited = self._visited(number, True)
        part = [asked.withColumn("bits", F.col("bits").bitwiseAND(m)).where("bits <> 0") for m in (_mask(self.turned), F.bitwise_not(_mask(self.turned)))]
        best = self._best(self.met_bottomup(part[0], visited, rows))
        if len(self.turned) < self.k:
            down = self._best(self.met_topdown(part[1]))
            least = [F.min(p).alias(p) for p in self.parents]
            best = best.unionByName(down).groupBy("vertex").agg(F.bit_or("bits").alias("bits"), F.max("level").alias("level"), *least)
        return self._new(best, visited)

    def _counts(self) -> list[Column]:
        return [F.count("*").alias("rows"), *[F.count_if(_has(F.col("bits"), i)).alias(f"n{i}") for i in range(self.k)]]

    def run(self) -> None:
        number, rows, searching = 0, self.k, set(range(self.k))
        while searching:
            began, told = time.time(), Observation()
            number += 1
            made = self.found(number, rows).observe(told, *self._counts())
            if rows <= THIN and len(self.held) < STRIDE:
                self.held.append(stored(made, "bfs-thin"))
            else:
                self._append(number, made)
            ended, got = time.time(), told.get
            rows = got.get("rows", 0)
            for i in sorted(searching):
                nf = got.get(f"n{i}", 0)
                self.rounds.append((self.roots[i], number - 1, nf, "bottom_up" if i in self.turned else "top_down", began, ended))
                if not nf:
                    searching.discard(i)
                elif self.switch_at is not None and nf > self.switch_at and i not in self.turned:
                    self.turned.append(i)

    def result(self) -> DataFrame:
        """(source, vertex, level, parent), read from the files; the table's name goes."""
        rows = _union(self.held) if self.held else None
        if self.stored_to >= 0:
            schema = self.levels.schema
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            stored_ones = self.spark.read.schema(schema).parquet(self.path)
            rows = stored_ones if rows is None else stored_ones.unionByName(rows)
        own = F.array(*[F.struct(F.lit(r).cast("bigint").alias("source"), F.col(p).alias("parent")) for r, p in zip(self.roots, self.parents, strict=True)])
        found = rows.select("vertex", "level", F.explode(F.filter(own, lambda x: x["parent"].isNotNull())).alias("x"))
        return found.select("x.source", "vertex", "level", "x.parent")


def _roots(spark: SparkSession, roots: Sequence[int] | DataFrame) -> list[int]:
    """The roots, distinct and in order. They are as many as the caller gives."""
    if isinstance(roots, DataFrame):
        roots = [r[0] for r in roots.select(F.col(roots.columns[0]).cast("bigint")).distinct().collect()]
    return sorted({int(r) for r in roots if r is not None})


@dataclass
class Found:
    """What searches found, and their rounds as they were run: (source, round, nf, direction, started, ended)."""

    result: DataFrame
    rounds: list[tuple] = field(default_factory=list)


def run(
    graph: Built, roots: Sequence[int] | DataFrame, symmetric: bool = False, switch_at: float | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> Found:
    """All searches, in batches of ``BATCH`` roots."""
    spark = graph.edges.sparkSession
    wanted, tables, rounds = _roots(spark, roots), [], []
    for at in range(0, len(wanted), BATCH):
        search = _Search(graph, wanted[at : at + BATCH], symmetric, switch_at, broadcast_rows)
        search.run()
        tables.append(search.result())
        rounds += search.rounds
    return Found(_union(tables) if tables else spark.createDataFrame([], RESULT), rounds)


def bfs(edges: DataFrame | Built, roots: Sequence[int] | DataFrame, symmetric: bool = False, switch_at: float | None = None) -> DataFrame:
    """(source, vertex, level, parent) of every vertex reached from each root.

    After a round in which a source finds more than ``switch_at`` vertices its further rounds run bottom-up.
    """
    if isinstance(edges, Built):
        return run(edges, roots, symmetric, switch_at).result
    graph = build(edges)
    found = run(graph, roots, symmetric, switch_at).result
    graph.release()
    return found


def balls(edges: DataFrame, reach: int) -> DataFrame:
    """(src, dst, hops): all vertices within ``reach`` hops of each src and their distance, by doubling.

    What is further away than ``done`` hops lies beyond a vertex at exactly that distance, so only
    the rims of the balls are carried on, and not every pair of rows.
    Meant for sparse, deep graphs: a vertex has as many rows as its ball has vertices.
    """
    near = edges.select("src", "dst", F.lit(1).alias("hops")).where("src <> dst").distinct()
    made, spare = stored(near, "bfs-ball"), []
    done = 1
    while done < reach:
        more = min(done, reach - done)
        spare.append(made)
        then = made.where(F.col("hops") <= more).select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("hops").alias("on"))
        further = made.where(F.col("hops") == done).join(then, "dst").select("src", F.col("far").alias("dst"), (F.col("hops") + F.col("on")).alias("hops")).where("src <> dst")
        made = stored(made.unionByName(further).groupBy("src", "dst").agg(F.min("hops").alias("hops")), "bfs-ball")
        done += more
    for table in spare:
        discard(table)
    return made


def with_parents(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """``levels(source, vertex, level)`` with the smallest parent of each vertex; a root is its own. One pass over the edges."""
    above = levels.select("source", F.col("vertex").alias("src"), (F.col("level") + 1).alias("level"))
    below = levels.where("level > 0").select("source", F.col("vertex").alias("dst"), "level")
    tree = above.join(edges.select("src", "dst"), "src").join(below, ["source", "dst", "level"])
    least = tree.groupBy("source", F.col("dst").alias("vertex")).agg(F.min("src").alias("parent"))
    roots = levels.where("level = 0").select("source", "vertex", "level", F.col("vertex").alias("parent"))
    return roots.unionByName(levels.where("level > 0").join(least, ["source", "vertex"]).select("source", "vertex", "level", "parent"))


def bfs_deep(edges: DataFrame, roots: Sequence[int] | DataFrame, reach: int = 8, symmetric: bool = False) -> DataFrame:
    """The rows of ``bfs`` for graphs that are sparse and deep: ``reach`` levels a round.

    A vertex up to ``reach`` levels below level L lies that near to a vertex of level L, so a round
    finds exact levels from the balls around these alone; parents follow in one pass at the end.
    Balls have half that reach: a round goes through them twice, from its level and from the rim
    that it finds, which reads as many rows as balls of the full reach have and shuffles none of them.
    """
    spark = edges.sparkSession
    half = -(-reach // 2)
    near = balls(edges, half)
    wanted = spark.createDataFrame([(r, r, 0) for r in _roots(spark, roots)], "source bigint, vertex bigint, level int")
    rings, at = [stored(wanted, "bfs-ring")], 0
    while True:
        last = rings[-1].where(F.col("level") == at).select("source", F.col("vertex").alias("src"))
        first = stored(last.join(near, "src").groupBy("source", F.col("dst").alias("vertex")).agg(F.min("hops").alias("hops")), "bfs-rim")
        rim = first.where(F.col("hops") == half).select("source", F.col("vertex").alias("src"))
        on = rim.join(near.where(F.col("hops") <= reach - half), "src").select("source", F.col("dst").alias("vertex"), (F.col("hops") + half).alias("hops"))
        found = first.unionByName(on).groupBy("source", "vertex").agg((F.min("hops") + at).cast("int").alias("level"))
        told = Observation()
        # a ball around a level of a symmetric graph ends ``reach`` levels back
        ring = stored(frontier_new(found, _union(rings[-2:] if symmetric else rings)).observe(told, F.count_if(F.col("level") == at + reach).alias("edge")), "bfs-ring")
        discard(first)
        rings, at = [*rings, ring], at + reach
        if not told.get.get("edge", 0):
            break
    levels = stored(_union(rings), "bfs-levels")
    for table in [*rings, near]:
        discard(table)
    return with_parents(levels, edges)


def rounds_of(result: DataFrame, switch_at: float | None = None) -> DataFrame:
    """(source, round, nf, direction) of a search's ``result``, one row per round, the last with nf 0."""
    sizes = result.groupBy("source", (F.col("level") - 1).alias("round")).agg(F.count("*").alias("nf")).where("round >= 0")
    last = result.groupBy("source").agg(F.max("level").alias("round")).select("source", "round", F.lit(0).cast("bigint").alias("nf"))
    every = sizes.unionByName(last)
    if switch_at is None:
        return every.select("source", F.col("round").cast("int").alias("round"), "nf", F.lit("top_down").alias("direction"))
    turn = sizes.where(F.col("nf") > switch_at).groupBy("source").agg(F.min("round").alias("turn"))
    direction = F.when(F.col("round") > F.col("turn"), "bottom_up").otherwise("top_down")
    return every.join(turn, "source", "left").select("source", F.col("round").cast("int").alias("round"), "nf", direction.alias("direction"))


def bfs_rounds(edges: DataFrame | Built, roots: Sequence[int] | DataFrame, symmetric: bool = False, switch_at: float | None = None) -> DataFrame:
    """(source, round, nf, direction) of the rounds as they were run, the last with nf 0."""
    graph = edges if isinstance(edges, Built) else build(edges)
    made = graph.edges.sparkSession.createDataFrame(run(graph, roots, symmetric, switch_at).rounds, ROUNDS)
    if graph is not edges:
        graph.release()
    return made.select("source", "round", "nf", "direction")


def switch_threshold(n: int, share: float = 0.15) -> int:
    """The round size above which the direction turns: ``share`` of the vertices, to the nearest even half."""
    return round(share * n)


def with_unreached(result: DataFrame, n: int, source: int) -> DataFrame:
    """All vertices 0 to n - 1; level and parent are -1 where not reached."""
    every = result.sparkSession.range(n).select(F.col("id").alias("vertex"))
    own = result.where(F.col("source") == source).drop("source")
    return every.join(own, "vertex", "left").select(
        F.lit(source).cast("bigint").alias("source"),
        "vertex",
        F.coalesce("level", F.lit(-1)).cast("int").alias("level"),
        F.coalesce("parent", F.lit(-1)).cast("bigint").alias("parent"),
    )


def visited_from_parent(parents: DataFrame) -> DataFrame:
    """``parents(source, vertex, parent)`` with visited: a parent is known, or the vertex is the root."""
    return parents.select("source", "vertex", ((F.col("parent") >= 0) | (F.col("vertex") == F.col("source"))).alias("visited"))


def radial_layout(result: DataFrame, step: float | None = None, n: int | None = None) -> DataFrame:
    """(vertex, level, place, angle, x, y) of one search's tree: a ring of radius ``level`` times ``step`` per level.

    Without ``step`` it is a tenth of the largest ring's vertices, 1.5 at least.

    A ring is divided evenly among its vertices, which stand in the order of their
    parents' places, then of their ids; the ring next to the root begins at angle 0,
    those further out half a share on. With ``n``, vertices 0 to n - 1 that were not
    reached stand by id on a ring of their own, outermost, with level -1. Rings are
    ranked one after the other by a range sort, never in one task.
    """
    spark = result.sparkSession
    tree = stored(result.select("vertex", "level", "parent"), "layout-tree")
    ring = tree.where("level = 0").select("vertex", "level", F.lit(0).cast("bigint").alias("place"))
    rings, level = [stored(ring, "layout-ring")], 0
    while True:
        level += 1
        inner = rings[-1].select(F.col("vertex").alias("parent"), F.col("place").alias("before"))
        ring = tree.where(F.col("level") == level).join(inner, "parent")
        if ring.isEmpty():
            break
        ranked = with_global_rank(ring.select("vertex", "level", "before"), [F.col("before"), F.col("vertex")], "place")
        rings.append(stored(ranked.select("vertex", "level", "place"), "layout-ring"))
    placed = _union(rings)
    size = placed.groupBy("level").agg(F.count("*").alias("size"))
    shift = F.when(F.col("level") > 1, F.lit(0.5)).otherwise(F.lit(0.0))
    share = F.lit(2 * np.pi) * (F.col("place") + shift) / F.col("size")
    if step is None:
        step = max(1.5, (size.agg(F.max("size")).first()[0] or 0) / 10)
    out = _at(placed.join(size, "level"), share, F.col("level") * F.lit(float(step)))
    if n is None:
        return out
    missing = spark.range(n).select(F.col("id").alias("vertex")).join(tree, "vertex", "left_anti")
    outer = with_global_rank(missing, [F.col("vertex")], "place").withColumn("level", F.lit(-1))
    many = missing.groupBy().agg(F.count("*").alias("size"))
    gap = F.greatest(F.lit(1.5), F.col("size") / 10.0)
    beyond = outer.join(many.withColumn("level", F.lit(-1)), "level")
    return out.unionByName(_at(beyond, F.lit(2 * np.pi) * F.col("place") / F.col("size"), F.lit(float(step * (level - 1))) + gap))


def _at(rows: DataFrame, angle: Column, radius: Column) -> DataFrame:
    turned = rows.withColumn("angle", angle)
    return turned.select("vertex", "level", "place", "angle", (radius * F.cos("angle")).alias("x"), (radius * F.sin("angle")).alias("y"))
