"""Named queries of the graph engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import units
from latticework.operators import adjacency, balance, blocks, checks, edges, grid, scatter, search, telemetry
from latticework.plans import derived
from latticework.plans.derived import CLOCK, GRAPH_SQL, MARKS_SQL, RUN_LOG_SQL, TICKS_SQL
from latticework.plans.tables import kept_until_exit, new_path, stored
from latticework.sources import graphs, results, rmat
from latticework.streaming import edge_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
GRID, BINS = 8, 20


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = " ".join(sql.split())
        return run

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _size(e: DataFrame) -> int:
    """Vertices 0 to the largest id."""
    largest = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return 0 if largest is None else largest + 1


def _least_source(e: DataFrame) -> DataFrame:
    return e.agg(F.min("src").alias("source"))


def _graph(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived graph, stored: plans that read it more than once scan it instead of joining again."""
    return stored(getattr(derived, name)(spark, sf_dir).select("src", "dst"), name)


#: Graphs whose plans give every edge once.
_DISTINCT = ("purchases",)


def _built(name: str, spark: SparkSession, sf_dir: str, hub_degree: int = 1_000_000) -> search.Built:
    """A derived graph in buckets by src, straight from its plan; whatever else reads its edges scans these."""
    e = getattr(derived, name)(spark, sf_dir).select("src", "dst")
    return search.build(e, hub_degree, distinct=name in _DISTINCT)


def _with(graph: str, more: str = "") -> str:
    return f"WITH RECURSIVE e AS ({GRAPH_SQL[graph]}), n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e){', ' + more if more else ''}"


_ROOT = "SELECT min(src) AS r FROM e"
_BFS = f"""b(v, lvl, parent) USING KEY (v) AS (SELECT r, 0, r FROM ({_ROOT}) UNION
    (SELECT e.dst, min(b.lvl) + 1, min(e.src) FROM b JOIN e ON e.src = b.v
     WHERE NOT EXISTS (SELECT 1 FROM recurring.b q WHERE q.v = e.dst) GROUP BY e.dst))"""
_ROOTS = """roots AS (SELECT src AS s FROM (SELECT src, count(*) FILTER (src <> dst) AS d FROM e GROUP BY src) WHERE d > 0
    ORDER BY md5('5:' || src), src LIMIT 6)"""
_MULTI = """b(s, v, lvl, parent) USING KEY (s, v) AS (SELECT s, s, 0, s FROM roots UNION
    (SELECT b.s, e.dst, min(b.lvl) + 1, min(e.src) FROM b JOIN e ON e.src = b.v
     WHERE NOT EXISTS (SELECT 1 FROM recurring.b q WHERE q.s = b.s AND q.v = e.dst) GROUP BY b.s, e.dst))"""


def _searched(graph: str) -> str:
    return _with(graph, _BFS)


# ---- edge tables ----


@_query("drop_self_loops", f"{_with('multigraph')} SELECT src, dst FROM e WHERE src <> dst")
def drop_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.drop_self_loops(derived.multigraph(spark, sf_dir))


@_query("dedup_edges", f"{_with('multigraph')} SELECT DISTINCT src, dst FROM e")
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.dedup_edges(derived.multigraph(spark, sf_dir))


@_query("symmetrize", f"{_with('multigraph')} SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst")
def symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.symmetrize(derived.multigraph(spark, sf_dir))


_SYMMETRY = """SELECT count(*) AS nnz, (SELECT count(*) FROM (SELECT src, dst FROM e EXCEPT ALL SELECT dst, src FROM e)) AS asymmetric,
    (SELECT count(*) FROM (SELECT src, dst FROM e EXCEPT ALL SELECT dst, src FROM e)) = 0 AS is_symmetric FROM e"""


@_query("is_symmetric", f"{_with('multigraph')} {_SYMMETRY}")
def is_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.is_symmetric(derived.multigraph(spark, sf_dir))


@_query("is_symmetric_purchases", f"{_with('purchases')} {_SYMMETRY}")
def is_symmetric_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.is_symmetric(derived.purchases(spark, sf_dir))


@_query("asymmetric_edges", f"{_with('multigraph')} SELECT src, dst, count(*) AS surplus FROM (SELECT src, dst FROM e EXCEPT ALL SELECT dst, src FROM e) GROUP BY ALL")
def asymmetric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.asymmetric_edges(derived.multigraph(spark, sf_dir))


@_query("out_degree", f"{_with('purchases')} SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.out_degree(derived.purchases(spark, sf_dir))


@_query("in_degree", f"{_with('multigraph')} SELECT dst AS vertex, count(*) AS degree FROM e GROUP BY dst")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.in_degree(derived.multigraph(spark, sf_dir))


@_query("degree_stats", f"""{_with('purchases')} SELECT count(*) AS n_sources, min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS avg_degree,
    quantile_cont(d, 0.5) AS median_degree FROM (SELECT count(*) AS d FROM e GROUP BY src)""")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.degree_stats(derived.purchases(spark, sf_dir))


@_query("graph_stats", f"""{_with('purchases')} SELECT (SELECT n FROM n) AS n, sum(d)::BIGINT AS nnz, round(sum(d) / (SELECT n FROM n), 6) AS avg_degree, max(d) AS max_degree
    FROM (SELECT count(*) AS d FROM e GROUP BY src)""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.graph_stats(derived.purchases(spark, sf_dir))


@_query("vertices_by_degree", f"""{_with('purchases')} SELECT src AS vertex, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, src) - 1 AS position
    FROM e GROUP BY src""")
def vertices_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.vertices_by_degree(derived.purchases(spark, sf_dir))


@_query("bfs_root_candidates", f"{_with('multigraph')} SELECT src AS vertex, count(*) FILTER (src <> dst) AS degree FROM e GROUP BY src HAVING count(*) FILTER (src <> dst) > 0")
def bfs_root_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.root_candidates(derived.multigraph(spark, sf_dir))


@_query("sample_roots", f"{_with('purchases', _ROOTS)} SELECT s AS vertex FROM roots")
def sample_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.sample_roots(derived.purchases(spark, sf_dir), 6, 5)


@_query("visited_difference", f"""WITH e AS ({GRAPH_SQL['event_steps']}) SELECT count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (b IS NULL) AS only_left
    FROM (SELECT DISTINCT src AS a FROM e) FULL JOIN (SELECT DISTINCT dst AS b FROM e) ON a = b""")
def visited_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = derived.event_steps(spark, sf_dir)
    both = e.select(F.col("src").alias("a")).distinct().join(e.select(F.col("dst").alias("b")).distinct(), F.col("a") == F.col("b"), "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"))


# ---- sources ----

_EDGE_LINES = """SELECT CASE WHEN event_id % 10 = 0 THEN '# comment ' || event_id WHEN event_id % 10 = 1 THEN '   '
    ELSE ' ' || user_id || chr(9) || (event_id % 500) || '  ' || event_type END AS value FROM events"""


def _edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of an edge list, some of them comments or blank."""
    kind = F.col("event_id") % 10
    words = F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit("\t"), (F.col("event_id") % 500).cast("string"), F.lit("  "), F.col("event_type"))
    line = F.when(kind == 0, F.concat(F.lit("# comment "), F.col("event_id").cast("string"))).when(kind == 1, "   ").otherwise(words)
    return derived.table(spark, sf_dir, "events").select(line.alias("value"))


@_query("edge_list_parse", f"""WITH t AS ({_EDGE_LINES}) SELECT regexp_extract(trim(value), '^(\\d+)\\s+(\\d+)', 1)::BIGINT AS src,
    regexp_extract(trim(value), '^(\\d+)\\s+(\\d+)', 2)::BIGINT AS dst FROM t WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')""")
def edge_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.edge_list_rows(_edge_lines(spark, sf_dir))


@_query("edge_list_size", f"""WITH t AS ({_EDGE_LINES}), g AS (SELECT regexp_extract(trim(value), '^(\\d+)\\s+(\\d+)', [ 'a', 'b' ]) AS m FROM t WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#'))
    SELECT greatest(900, max(greatest(m.a::BIGINT, m.b::BIGINT)) + 1) AS n FROM g""")
def edge_list_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = spark.range(1).select(F.lit("# Nodes: 900 Edges: 12").alias("value"))
    return graphs.vertex_count(head.unionByName(_edge_lines(spark, sf_dir)))


@_query("rmat_edges", f"{_with('small_world')} SELECT src, dst FROM e")
def rmat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.small_world(spark, sf_dir)


@_query("rmat_degree", f"{_with('small_world')} SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src")
def rmat_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.out_degree(derived.small_world(spark, sf_dir))


@_query("rmat_exact_stats")
def rmat_exact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.graph_stats(rmat.rmat(spark, 10, 16, 0), 1 << 10)


@_query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.page_links(spark, sf_dir)


@_query("edge_stream_degrees", f"{_with('purchases')} SELECT src AS vertex, count(*) AS degree FROM e GROUP BY src")
def edge_stream_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_stream.replay_degrees(derived.purchases(spark, sf_dir))


# ---- blocks ----

_BLK = f"k AS (SELECT (n + {GRID - 1}) // {GRID} AS k FROM n), blk AS (SELECT src, dst, dst // k AS row_b, src // k AS col_b, dst % k AS row_l, src % k AS col_l FROM e, k)"
_NNZ = f"""{_BLK}, full_grid AS (SELECT r AS row_b, c AS col_b FROM range({GRID}) a(r), range({GRID}) b(c)),
    loads AS (SELECT row_b, col_b, count(src) AS nnz FROM full_grid LEFT JOIN blk USING (row_b, col_b) GROUP BY row_b, col_b)"""


def _blocks(spark: SparkSession, sf_dir: str, graph: str = "purchases") -> tuple[DataFrame, int]:
    e = _graph(graph, spark, sf_dir)
    return e, _size(e)


@_query("block_coords", f"{_with('purchases', _BLK)} SELECT * FROM blk")
def block_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_coords(*_blocks(spark, sf_dir), GRID)


@_query("nnz_per_block", f"{_with('purchases', _NNZ)} SELECT * FROM loads")
def nnz_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nnz_per_block(*_blocks(spark, sf_dir), GRID)


@_query("nz_cols_per_block", f"{_with('purchases', _BLK)} SELECT row_b, col_b, count(DISTINCT src) AS nz_cols FROM blk GROUP BY ALL")
def nz_cols_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nz_lines_per_block(*_blocks(spark, sf_dir), GRID).select("row_b", "col_b", "nz_cols")


@_query("nz_rows_per_block", f"{_with('purchases', _BLK)} SELECT row_b, col_b, count(DISTINCT dst) AS nz_rows FROM blk GROUP BY ALL")
def nz_rows_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nz_lines_per_block(*_blocks(spark, sf_dir), GRID).select("row_b", "col_b", "nz_rows")


@_query("partition_maxima", f"""{_with('purchases', _BLK)} SELECT max(a) AS max_nnz, max(b) AS max_nz_cols, max(c) AS max_nz_rows FROM
    (SELECT count(*) AS a, count(DISTINCT src) AS b, count(DISTINCT dst) AS c FROM blk GROUP BY row_b, col_b)""")
def partition_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.partition_maxima(*_blocks(spark, sf_dir), GRID)


@_query("compressed_columns", f"""{_with('purchases', _BLK)}, c AS (SELECT row_b, col_b, col_l, count(*) AS col_len, list(row_l ORDER BY row_l) AS r FROM blk GROUP BY ALL)
    SELECT row_b, col_b, col_l, row_number() OVER w - 1 AS col_idx, coalesce(sum(col_len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS col_loc,
    col_len, array_to_string(r, ';') AS rows FROM c WINDOW w AS (PARTITION BY row_b, col_b ORDER BY col_l)""")
def compressed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = blocks.compressed_columns(*_blocks(spark, sf_dir), GRID)
    return made.withColumn("rows", units.joined(F.col("rows")))


@_query("nonzero_ranks", f"""{_with('purchases', _BLK)} SELECT row_b, col_b, src, dst, row_number() OVER w - 1 AS rank_in_col, lag(dst) OVER w IS NULL AS opens_col
    FROM blk WINDOW w AS (PARTITION BY row_b, col_b, src ORDER BY dst)""")
def nonzero_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nonzero_ranks(*_blocks(spark, sf_dir), GRID)


@_query("csr_offsets", f"""{_with('purchases')}, d AS (SELECT v AS vertex, count(src) AS degree FROM range((SELECT n FROM n)) r(v) LEFT JOIN e ON src = v GROUP BY v)
    SELECT vertex, degree, coalesce(sum(degree) OVER (ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM d""")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.csr_offsets(*_blocks(spark, sf_dir))


@_query("load_imbalance", f"""{_with('purchases', _NNZ)} SELECT max(nnz) AS max_nnz, round(avg(nnz), 6) AS mean_nnz, round(max(nnz) / avg(nnz), 6) AS peak_mean_ratio,
    round(sum(nnz) / ({GRID * GRID} * max(nnz)), 6) AS balance_factor FROM loads""")
def load_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.load_imbalance(*_blocks(spark, sf_dir), GRID)


@_query("load_summary", f"""{_with('purchases', _NNZ)} SELECT round(count(*) FILTER (nnz = 0) / count(*), 6) AS empty_share, round(avg(nnz) FILTER (nnz > 0), 6) AS mean_load,
    quantile_cont(nnz, 0.5) FILTER (nnz > 0) AS median_load, max(nnz) AS max_load FROM loads""")
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.load_summary(*_blocks(spark, sf_dir), GRID)


@_query("load_histogram", f"""{_with('purchases', _NNZ)}, sp AS (SELECT log10(min(nnz)) AS a, log10(max(nnz)) AS b FROM loads WHERE nnz > 0),
    cuts AS (SELECT DISTINCT round_even(pow(10, a + (b - a) * i / {BINS}), 0)::BIGINT AS low FROM sp, range({BINS + 1}) r(i)),
    bins AS (SELECT low, lead(low) OVER (ORDER BY low) AS high, row_number() OVER (ORDER BY low DESC) = 2 AS last FROM cuts)
    SELECT low, high, count(*) AS n_blocks, round(100.0 * count(*) / (SELECT count(*) FROM loads WHERE nnz > 0), 6) AS percent
    FROM loads JOIN bins ON nnz >= low AND (nnz < high OR (last AND nnz <= high)) WHERE high IS NOT NULL GROUP BY low, high""")
def load_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.load_histogram(*_blocks(spark, sf_dir), GRID, BINS)


@_query("density_2d", f"""{_with('purchases')} SELECT dst * {BINS} // n AS row_bin, src * {BINS} // n AS col_bin, count(*) AS n_edges FROM e, n GROUP BY ALL""")
def density_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.density_2d(*_blocks(spark, sf_dir), BINS)


_PERM = "perm AS (SELECT v AS old_id, (n - 1 - v)::BIGINT AS new_id FROM n, range((SELECT n FROM n)) r(v))"


def _mirror(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("old_id"), (n - 1 - F.col("id")).alias("new_id"))


@_query("relabel_edges", f"{_with('purchases', _PERM)} SELECT a.new_id AS src, b.new_id AS dst FROM e JOIN perm a ON a.old_id = src JOIN perm b ON b.old_id = dst")
def relabel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _blocks(spark, sf_dir)
    return edges.relabel(e, _mirror(spark, n))


@_query("translate_source", f"{_with('purchases', _PERM)} SELECT old_id, new_id FROM perm WHERE old_id = 17")
def translate_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.translate_source(_mirror(spark, _size(derived.purchases(spark, sf_dir))), 17)


_SERPENTINE = f"""k AS (SELECT (n + {GRID - 1}) // {GRID} AS k FROM n), dg AS (SELECT v, count(src) AS d FROM range((SELECT n FROM n)) r(v) LEFT JOIN e ON dst = v GROUP BY v),
    rk AS (SELECT v, row_number() OVER (ORDER BY d DESC, v) - 1 AS p FROM dg),
    perm AS (SELECT v AS old_id, CASE WHEN p // {GRID} % 2 = 0 THEN p % {GRID} ELSE {GRID - 1} - p % {GRID} END * k + p // {GRID} AS new_id FROM rk, k)"""


@_query("balance_serpentine", f"{_with('purchases', _SERPENTINE)} SELECT old_id, new_id FROM perm")
def balance_serpentine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.balance_serpentine(*_blocks(spark, sf_dir), GRID)


@_query("balance_greedy")
def balance_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balance_greedy(*_blocks(spark, sf_dir), GRID)


_AFTER = f"""f AS (SELECT a.new_id AS src, b.new_id AS dst FROM e JOIN perm a ON a.old_id = src JOIN perm b ON b.old_id = dst),
    two AS (SELECT 'before' AS stage, src, dst FROM e UNION ALL SELECT 'after', src, dst FROM f),
    cells AS (SELECT s AS stage, r AS row_b, c AS col_b FROM (VALUES ('before'), ('after')) v(s), range({GRID}) a(r), range({GRID}) b(c)),
    ld AS (SELECT cells.stage, cells.row_b, cells.col_b, count(src) AS nnz FROM cells LEFT JOIN (SELECT stage, dst // k AS row_b, src // k AS col_b, src FROM two, k) x
        USING (stage, row_b, col_b) GROUP BY ALL)"""


@_query("balance_before_after", f"""{_with('purchases', _SERPENTINE + ', ' + _AFTER)} SELECT stage, sum(nnz)::BIGINT AS nnz, min(nnz) AS min_nnz, max(nnz) AS max_nnz,
    round(max(nnz) / greatest(min(nnz), 1), 6) AS ratio FROM ld GROUP BY stage""")
def balance_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _blocks(spark, sf_dir)
    return blocks.balance_before_after(e, blocks.balance_serpentine(e, n, GRID), n, GRID)


_SEED = 11
_SCATTERED = f"ids AS (SELECT v AS old_id, {scatter.scattered_sql('v', 'n', _SEED)} AS new_id FROM n, range((SELECT n FROM n)) r(v))"


@_query("scatter_edges", f"{_with('purchases', _SCATTERED)} SELECT a.new_id AS src, b.new_id AS dst FROM e JOIN ids a ON a.old_id = src JOIN ids b ON b.old_id = dst")
def scatter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scatter.scatter(*_blocks(spark, sf_dir), _SEED)


@_query("balance_baselines", f"""{_with('purchases', _SERPENTINE + ', ' + _SCATTERED)}, lab AS (SELECT 'before' AS stage, old_id, old_id AS new_id FROM perm
        UNION ALL SELECT 'random', old_id, new_id FROM ids UNION ALL SELECT 'serpentine', old_id, new_id FROM perm),
    x AS (SELECT stage, b.new_id // k AS row_b, a.new_id // k AS col_b, count(*) AS nnz FROM e JOIN lab a ON a.old_id = src JOIN lab b USING (stage), k WHERE b.old_id = dst GROUP BY ALL),
    cells AS (SELECT s AS stage, r AS row_b, c AS col_b FROM (VALUES ('before'), ('random'), ('serpentine')) v(s), range({GRID}) a(r), range({GRID}) b(c)),
    ld AS (SELECT cells.*, coalesce(nnz, 0) AS nnz FROM cells LEFT JOIN x USING (stage, row_b, col_b))
    SELECT stage, sum(nnz)::BIGINT AS nnz, min(nnz)::BIGINT AS min_nnz, max(nnz)::BIGINT AS max_nnz, round(max(nnz) / greatest(min(nnz), 1), 6) AS ratio FROM ld GROUP BY stage""")
def balance_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _blocks(spark, sf_dir)
    dealt = edges.relabel(e, blocks.balance_serpentine(e, n, GRID))
    return blocks.balance_stages({"before": e, "random": scatter.scatter(e, n, _SEED), "serpentine": dealt}, n, GRID)


@_query("bit_or_reduce", f"{_with('multigraph')} SELECT dst AS vertex, bit_or(1::BIGINT << (src % 60)) AS sources FROM e GROUP BY dst")
def bit_or_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("src") % 60).cast("int"))
    return derived.multigraph(spark, sf_dir).groupBy(F.col("dst").alias("vertex")).agg(F.bit_or(bit).alias("sources"))


@_query("neighbours_of", f"{_with('purchases', _ROOTS)} SELECT src AS vertex, dst AS neighbour FROM e WHERE src IN (SELECT s FROM roots)")
def neighbours_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of six vertices, looked up in compressed segments."""
    e = _graph("purchases", spark, sf_dir)
    return adjacency.neighbours_of(adjacency.build_adjacency(e, span=1024, segment=4096), edges.sample_roots(e, 6, 5))


# ---- search ----


def _register_search(graph: str, symmetric: bool, suffix: str, deep: bool = False) -> None:
    def found(e: DataFrame) -> DataFrame:
        return search.bfs_deep(e, _least_source(e), symmetric=symmetric) if deep else search.bfs(e, _least_source(e), symmetric)

    @_query(f"bfs_levels{suffix}", f"{_searched(graph)} SELECT v AS vertex, lvl AS level FROM b")
    def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _graph(graph, spark, sf_dir)
        return found(e).select("vertex", "level")

    @_query(f"bfs_parents{suffix}", f"{_searched(graph)} SELECT v AS vertex, parent FROM b")
    def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _graph(graph, spark, sf_dir)
        return found(e).select("vertex", "parent")


_register_search("purchases", True, "")
_register_search("customer_orders", True, "_sparse")
_register_search("event_steps", False, "_directed")
_register_search("small_world", True, "_rmat")
# long thin paths, eight levels a round
_register_search("event_paths", True, "_paths", deep=True)


@_query("bfs_levels_distributed_g1", f"{_searched('purchases')} SELECT v AS vertex, lvl AS level, parent FROM b")
def bfs_levels_distributed_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a hub degree so small that most vertices are hubs in several parts."""
    e = _graph("purchases", spark, sf_dir)
    return search.bfs(search.build(e, hub_degree=20), _least_source(e), True).select("vertex", "level", "parent")


@_query("bfs_all_vertices", f"""{_searched('purchases')} SELECT (SELECT r FROM ({_ROOT})) AS source, u AS vertex, coalesce(lvl, -1) AS level, coalesce(parent, -1) AS parent
    FROM range((SELECT n FROM n)) x(u) LEFT JOIN b ON v = u""")
def bfs_all_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _blocks(spark, sf_dir)
    root = _least_source(e).first()["source"]
    return search.with_unreached(search.bfs(e, [root], True), n, root)


@_query("bfs_tree_depth_counts", f"{_searched('purchases')} SELECT (SELECT r FROM ({_ROOT})) AS source, lvl AS level, count(*) AS n_vertices FROM b GROUP BY lvl")
def bfs_tree_depth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("purchases", spark, sf_dir)
    return checks.depth_counts(search.bfs(e, _least_source(e), True))


@_query("bfs_eccentricity", f"{_searched('event_paths')} SELECT (SELECT r FROM ({_ROOT})) AS source, max(lvl) AS eccentricity, max(lvl) + 1 AS rounds, count(*) AS visited FROM b")
def bfs_eccentricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("event_paths", spark, sf_dir)
    return checks.eccentricity(search.bfs_deep(e, _least_source(e), symmetric=True))


_ROUNDS = f"""nf AS (SELECT lvl - 1 AS round, count(*) AS nf FROM b WHERE lvl > 0 GROUP BY lvl),
    h AS (SELECT * FROM nf UNION ALL SELECT coalesce(max(round), -1) + 1, 0 FROM nf),
    turn AS (SELECT min(round) AS t FROM h, n WHERE nf > round_even(0.15 * n, 0))"""


@_query("frontier_size", f"{_searched('purchases')}, {_ROUNDS} SELECT (SELECT r FROM ({_ROOT})) AS source, round, nf FROM h")
def frontier_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("purchases", spark, sf_dir)
    return search.bfs_rounds(e, _least_source(e), True).select("source", "round", "nf")


_DIRECTION = "CASE WHEN round > (SELECT t FROM turn) THEN 'bottom_up' ELSE 'top_down' END"


@_query("bfs_direction_history", f"{_searched('purchases')}, {_ROUNDS} SELECT (SELECT r FROM ({_ROOT})) AS source, round, nf, {_DIRECTION} AS direction FROM h")
def bfs_direction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _blocks(spark, sf_dir)
    return search.bfs_rounds(e, _least_source(e), True, switch_at=search.switch_threshold(n))


@_query("switch_round", f"""{_searched('purchases')}, {_ROUNDS} SELECT (SELECT r FROM ({_ROOT})) AS source, min(round) FILTER ({_DIRECTION} = 'bottom_up') AS switch_round FROM h""")
def switch_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.switch_round(bfs_direction_history(spark, sf_dir))


@_query("bfs_multi_source", f"{_with('customer_orders', _ROOTS + ', ' + _MULTI)} SELECT s AS source, v AS vertex, lvl AS level, parent FROM b")
def bfs_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("customer_orders", spark, sf_dir)
    return search.bfs(e, edges.sample_roots(e, 6, 5), True)


@_query("bfs_multi_source_distributed", f"{_with('purchases', _ROOTS + ', ' + _MULTI)} SELECT s AS source, v AS vertex, lvl AS level, parent FROM b")
def bfs_multi_source_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six roots that turn to searching bottom-up, each by its own rounds."""
    graph = _built("purchases", spark, sf_dir)
    found = search.bfs(graph, edges.sample_roots(graph.edges, 6, 5), True, search.switch_threshold(_size(graph.edges)))
    graph.release()
    return found


@_query("bfs_direction_multi_source", f"""{_with('purchases', _ROOTS + ', ' + _MULTI)}, nf AS (SELECT s AS source, lvl - 1 AS round, count(*) AS nf FROM b WHERE lvl > 0 GROUP BY ALL),
    h AS (SELECT * FROM nf UNION ALL SELECT s, max(lvl), 0 FROM b GROUP BY s), turn AS (SELECT source, min(round) AS t FROM h, n WHERE nf > round_even(0.15 * n, 0) GROUP BY source)
    SELECT source, round, nf, CASE WHEN round > t THEN 'bottom_up' ELSE 'top_down' END AS direction FROM h LEFT JOIN turn USING (source)""")
def bfs_direction_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _built("purchases", spark, sf_dir)
    made = search.bfs_rounds(graph, edges.sample_roots(graph.edges, 6, 5), True, search.switch_threshold(_size(graph.edges)))
    graph.release()
    return made


def _grid_cells(spark: SparkSession, sf_dir: str) -> tuple[grid.Cells, int]:
    """The purchases in a grid of cells with small segments, and the least vertex with an edge."""
    e, n = _blocks(spark, sf_dir)
    return grid.build_cells(e, n, GRID, segment=4096), _least_source(e).first()["source"]


@_query("bfs_levels_grid", f"{_searched('purchases')} SELECT v AS vertex, lvl AS level, parent FROM b")
def bfs_levels_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by blocks: frontier pages go down the columns of cells, candidates are reduced along the rows."""
    return grid.bfs_grid(*_grid_cells(spark, sf_dir)).select("vertex", "level", "parent")


@_query("frontier_bitmap_rounds", f"{_searched('purchases')}, {_ROUNDS} SELECT (SELECT r FROM ({_ROOT})) AS source, round, nf FROM h")
def frontier_bitmap_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier sizes as the popcounts of the rounds' bitmaps."""
    cells, root = _grid_cells(spark, sf_dir)
    pages = grid.search_cells(cells, root).pages.where("level > 0")
    sizes = pages.groupBy((F.col("level") - 1).alias("round")).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("nf"))
    last = pages.agg(F.coalesce(F.max("level"), F.lit(0)).alias("round"), F.lit(0).cast("bigint").alias("nf"))
    return sizes.unionByName(last).select(F.lit(root).cast("bigint").alias("source"), F.col("round").cast("int").alias("round"), "nf")


@_query("grid_cell_candidates", f"{_with('purchases', _BLK)}, ring AS (SELECT dst AS v FROM e WHERE src = ({_ROOT})) SELECT row_b, count(DISTINCT dst) AS n_candidates FROM blk WHERE src IN (SELECT v FROM ring) GROUP BY row_b")
def grid_cell_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one expansion by block row, from the OR-reduced pages."""
    cells, root = _grid_cells(spark, sf_dir)
    size = blocks.block_edge(cells.n, GRID)
    ring = grid.page_vertices(grid.candidates(cells, grid.bitmap_pages(spark.createDataFrame([(root,)], "vertex bigint"))))
    second = grid.page_vertices(grid.candidates(cells, grid.bitmap_pages(ring)))
    return second.groupBy(F.expr(f"vertex div {size}").alias("row_b")).agg(F.count("*").alias("n_candidates"))


_FRONTIER = f"fr AS (SELECT DISTINCT dst AS v FROM e WHERE src = ({_ROOT})), vis AS (SELECT v FROM fr UNION {_ROOT})"


def _step(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges, the first ring around the least vertex, and what is visited with it."""
    e = _graph("purchases", spark, sf_dir)
    root = _least_source(e).select(F.col("source").alias("src"))
    zero = F.lit(0).cast("bigint").alias("source")
    ring = e.join(root, "src").select(zero, F.col("dst").alias("vertex")).distinct()
    return e, ring, ring.unionByName(root.select(zero, F.col("src").alias("vertex")))


@_query("bfs_expand_topdown", f"{_with('purchases', _FRONTIER)} SELECT dst AS vertex, min(src) AS parent FROM e JOIN fr ON v = src GROUP BY dst")
def bfs_expand_topdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, frontier, _ = _step(spark, sf_dir)
    return search.expand_topdown(e, frontier).select("vertex", "parent")


@_query("bfs_expand_bottomup", f"{_with('purchases', _FRONTIER)} SELECT dst AS vertex, min(src) AS parent FROM e JOIN fr ON v = src WHERE dst NOT IN (SELECT v FROM vis) GROUP BY dst")
def bfs_expand_bottomup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.expand_bottomup(*_step(spark, sf_dir)).select("vertex", "parent")


@_query("frontier_new", f"{_with('purchases', _FRONTIER)} SELECT DISTINCT dst AS vertex FROM e JOIN fr ON v = src WHERE dst NOT IN (SELECT v FROM vis)")
def frontier_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, frontier, visited = _step(spark, sf_dir)
    return search.frontier_new(search.expand_topdown(e, frontier), visited).select("vertex")


@_query("parent_resolve", f"""{_with('multigraph')} SELECT dst AS vertex, min(p) AS parent FROM (SELECT dst, src % 8 AS part, min(src) AS p FROM e GROUP BY ALL) GROUP BY dst""")
def parent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _graph("multigraph", spark, sf_dir).groupBy("dst", (F.col("src") % 8).alias("part")).agg(F.min("src").alias("p"))
    return parts.groupBy(F.col("dst").alias("vertex")).agg(F.min("p").alias("parent"))


@_query("visited_from_parent", f"""{_searched('purchases')} SELECT (SELECT r FROM ({_ROOT})) AS source, u AS vertex, v IS NOT NULL AS visited
    FROM range((SELECT n FROM n)) x(u) LEFT JOIN b ON v = u""")
def visited_from_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.visited_from_parent(bfs_all_vertices(spark, sf_dir))


@_query("bfs_radial_layout", f"""{_searched('purchases')}, ring(v, lvl, place) AS (SELECT v, lvl, 0::BIGINT FROM b WHERE lvl = 0 UNION ALL
    (SELECT b.v, b.lvl, row_number() OVER (ORDER BY ring.place, b.v) - 1 FROM b JOIN ring ON b.parent = ring.v AND b.lvl = ring.lvl + 1)),
    sized AS (SELECT lvl, count(*) AS size FROM ring GROUP BY lvl), far AS (SELECT max(lvl) AS far, greatest(1.5, max(size) / 10) AS step FROM sized),
    missed AS (SELECT u AS v, row_number() OVER (ORDER BY u) - 1 AS place, count(*) OVER () AS size FROM range((SELECT n FROM n)) x(u) WHERE u NOT IN (SELECT v FROM b)),
    turned AS (SELECT v, lvl, place, 2 * pi() * (place + CASE WHEN lvl > 1 THEN 0.5 ELSE 0 END) / size AS angle, lvl * step AS radius FROM ring JOIN sized USING (lvl), far
        UNION ALL SELECT v, -1, place, 2 * pi() * place / size, far * step + greatest(1.5, size / 10) FROM missed, far)
    SELECT v AS vertex, lvl AS level, place, round(angle, 6) AS angle, round(radius * cos(angle), 6) AS x, round(radius * sin(angle), 6) AS y FROM turned""")
def bfs_radial_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = _blocks(spark, sf_dir)
    made = search.radial_layout(search.bfs(e, _least_source(e), True), n=n)
    # adding zero takes the sign off a rounded zero
    return made.select("vertex", "level", "place", *[(F.round(c, 6) + 0.0).alias(c) for c in ("angle", "x", "y")])


# ---- validation and counts ----


@_query("bfs_invalid_parents", f"""{_searched('purchases')}, w AS (SELECT v, lvl, CASE WHEN v % 9 = 4 THEN parent + 2 ELSE parent END AS parent FROM b)
    SELECT (SELECT r FROM ({_ROOT})) AS source, w.v AS vertex, w.parent, CASE WHEN u.v IS NULL THEN 'parent not visited' WHEN e.src IS NULL THEN 'no such edge' ELSE 'not one level up' END AS reason
    FROM w LEFT JOIN b u ON u.v = w.parent LEFT JOIN e ON e.src = w.parent AND e.dst = w.v
    WHERE w.v <> (SELECT r FROM ({_ROOT})) AND (u.v IS NULL OR e.src IS NULL OR u.lvl <> w.lvl - 1)""")
def bfs_invalid_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("purchases", spark, sf_dir)
    wrong = F.when(F.col("vertex") % 9 == 4, F.col("parent") + 2).otherwise(F.col("parent"))
    found = search.bfs(e, _least_source(e), True).withColumn("parent", F.when(F.col("level") == 0, F.col("parent")).otherwise(wrong))
    return checks.invalid_parents(found, e)


@_query("bfs_compare", f"""{_searched('purchases')}, w AS (SELECT v, lvl + (v % 11 = 3)::INT AS lvl, parent + (v % 13 = 5)::INT AS parent FROM b WHERE v % 17 <> 1)
    SELECT (SELECT r FROM ({_ROOT})) AS source, count(*) AS n_vertices, count(*) FILTER (w.v IS NULL) AS visited_mismatch, count(*) FILTER (w.lvl <> b.lvl) AS level_mismatch,
    count(*) FILTER (w.parent <> b.parent) AS parent_differs FROM b LEFT JOIN w USING (v)""")
def bfs_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("purchases", spark, sf_dir)
    found = search.bfs(e, _least_source(e), True)
    other = found.where("vertex % 17 <> 1").select(
        "source", "vertex", (F.col("level") + (F.col("vertex") % 11 == 3).cast("int")).alias("level"), (F.col("parent") + (F.col("vertex") % 13 == 5).cast("int")).alias("parent")
    )
    return checks.compare(found, other)


@_query("bfs_validate", f"""{_searched('purchases')}, w AS (SELECT v, lvl + (v % 31 = 7)::INT AS lvl, parent FROM b WHERE v % 37 <> 5),
    bad AS (SELECT count(*) AS n FROM w LEFT JOIN w u ON u.v = w.parent WHERE w.v <> (SELECT r FROM ({_ROOT})) AND (u.v IS NULL OR u.lvl <> w.lvl - 1)),
    long AS (SELECT count(*) AS n FROM w JOIN e ON e.src = w.v LEFT JOIN w t ON t.v = e.dst WHERE t.v IS NULL OR t.lvl > w.lvl + 1)
    SELECT (SELECT r FROM ({_ROOT})) AS source, bad.n AS n_invalid_parents, long.n AS n_long_edges, bad.n = 0 AND long.n = 0 AS correctness_ok FROM bad, long""")
def bfs_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _built("purchases", spark, sf_dir)
    spoilt = search.bfs(graph, _least_source(graph.edges), True).where("vertex % 37 <> 5")
    return checks.validate(spoilt.withColumn("level", F.col("level") + (F.col("vertex") % 31 == 7).cast("int")), graph.edges)


@_query("edges_traversed_undirected", f"{_searched('purchases')} SELECT (SELECT r FROM ({_ROOT})) AS source, count(*) AS m FROM e JOIN b ON v = dst WHERE src <= dst")
def edges_traversed_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("purchases", spark, sf_dir)
    return checks.edges_traversed(search.bfs(e, _least_source(e), True), e, True)


@_query("edges_traversed_directed", f"{_searched('event_steps')} SELECT (SELECT r FROM ({_ROOT})) AS source, count(*) AS m FROM e JOIN b ON v = src")
def edges_traversed_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _graph("event_steps", spark, sf_dir)
    return checks.edges_traversed(search.bfs_deep(e, _least_source(e)), e, False)


_SEARCHES = f"""{_with('purchases', _ROOTS + ', ' + _MULTI)}, vis AS (SELECT s, count(*) AS visited, max(lvl) + 1 AS rounds FROM b GROUP BY s),
    mm AS (SELECT s, count(*) AS m FROM b JOIN e ON v = dst WHERE src <= dst GROUP BY s),
    searches AS (SELECT s AS source, rounds, visited, m, visited * 100 + s AS cycles, m / ((visited * 100 + s)::DOUBLE / {CLOCK}) / 1e9 AS gteps FROM vis JOIN mm USING (s))"""


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per search; search time is a made-up number of cycles, so that rows can be compared."""
    graph = _built("purchases", spark, sf_dir)
    found = search.bfs(graph, edges.sample_roots(graph.edges, 6, 5), True)
    joined = checks.eccentricity(found).join(checks.edges_traversed(found, graph.edges, True), "source")
    cycles = F.col("visited") * 100 + F.col("source")
    return joined.select("source", "rounds", "visited", "m", cycles.alias("cycles"), units.gteps(F.col("m"), cycles).alias("gteps"))


@_query("graph500_searches", f"{_SEARCHES} SELECT source, rounds, visited, m, cycles, round(gteps, 9) AS gteps FROM searches")
def graph500_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searches(spark, sf_dir).withColumn("gteps", F.round("gteps", 9))


_RATES = """count(*) AS num_searches, count(g) AS num_rates, round(count(g) / sum(1.0 / g), 9) AS harmonic_mean, round(min(g), 9) AS min_rate,
    round(quantile_cont(g, 0.5), 9) AS median_rate, round(max(g), 9) AS max_rate"""


@_query("graph500_summary", f"{_SEARCHES} SELECT {_RATES} FROM (SELECT CASE WHEN gteps > 0 THEN gteps END AS g FROM searches)")
def graph500_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.rate_summary(_searches(spark, sf_dir))


# ---- telemetry and reports ----

_LOG = f"WITH log AS ({RUN_LOG_SQL})"
_LATEST = f"{_LOG}, latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY scale, grid ORDER BY ts DESC, run_id DESC) = 1)"
_RATE = f"CASE WHEN total_cycles - resolve_cycles > 0 THEN m / ((total_cycles - resolve_cycles)::DOUBLE / {CLOCK}) / 1e9 END"
_SUM = "list_sum(string_split({0}, ';')::BIGINT[])"
_PCT = f"CASE WHEN total_cycles - resolve_cycles > 0 THEN (total_cycles - resolve_cycles - {_SUM.format('compute')} - {_SUM.format('term')})::DOUBLE / (total_cycles - resolve_cycles) * 100 END"


def _latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.latest(derived.run_log(spark, sf_dir), ["scale", "grid"], [F.col("ts").desc(), F.col("run_id").desc()])


def _net() -> F.Column:
    return F.col("total_cycles") - F.col("resolve_cycles")


@_query("decode_timestamps", f"SELECT *, t_end - t_start AS cycles FROM ({TICKS_SQL})")
def decode_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.decoded(derived.tick_rows(spark, sf_dir), ["l_orderkey", "round", "row_b", "col_b"])


@_query("phase_stats", f"""SELECT 'compute' AS phase, round, min(t_end - t_start) AS min_cycles, max(t_end - t_start) AS max_cycles, round(avg(t_end - t_start), 1) AS avg_cycles
    FROM ({TICKS_SQL}) GROUP BY round""")
def phase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.phase_stats(decode_timestamps(spark, sf_dir).withColumn("phase", F.lit("compute")))


@_query("round_duration", f"SELECT round, max(t_end - t_start) AS duration FROM ({TICKS_SQL}) GROUP BY round")
def round_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.round_duration(decode_timestamps(spark, sf_dir))


@_query("sync_span", f"SELECT run, max(toc - (ref - abs(col_b - 4))) - min(tic - (ref - abs(col_b - 4))) AS span FROM ({MARKS_SQL}) GROUP BY run")
def sync_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.sync_span(derived.sync_marks(spark, sf_dir), 8)


@_query("self_delta", f"SELECT run, max(toc - tic) AS longest FROM ({MARKS_SQL}) GROUP BY run")
def self_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.self_delta(derived.sync_marks(spark, sf_dir))


@_query("run_log_latest", f"{_LATEST} SELECT scale, grid, run_id, total_cycles FROM latest")
def run_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_runs(spark, sf_dir).select("scale", "grid", "run_id", "total_cycles")


@_query("pending_cases", f"""{_LOG} SELECT s AS scale, g AS grid FROM range(10, 21) a(s), unnest([4, 8, 16, 32, 64, 128, 256, 512, 750]::BIGINT[]) b(g)
    WHERE NOT EXISTS (SELECT 1 FROM log WHERE total_cycles > 5010000 AND scale = s AND grid = g)""")
def pending_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    scales = spark.range(10, 21).select(F.col("id").alias("scale"))
    planned = scales.withColumn("grid", F.explode(F.array(*[F.lit(g).cast("bigint") for g in derived.GRIDS])))
    return telemetry.pending(planned, derived.run_log(spark, sf_dir).where("total_cycles > 5010000"), ["scale", "grid"])


@_query("log_cases", f"""{_LOG}, named AS (SELECT run_id, 'rmat_s' || scale || '_e16.balanced' || grid || 'x' || grid || '.mtx' AS file FROM log)
    SELECT run_id, regexp_extract(file, '^rmat_s(\\d+)_e16\\.balanced(\\d+)x(\\d+)\\.mtx$', 1)::BIGINT AS scale,
    regexp_extract(file, '^rmat_s(\\d+)_e16\\.balanced(\\d+)x(\\d+)\\.mtx$', 2)::BIGINT AS grid FROM named WHERE NOT (file LIKE '%s12_%' AND file LIKE '%x64.%')""")
def log_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.run_log(spark, sf_dir)
    name = F.format_string("rmat_s%d_e16.balanced%dx%d.mtx", "scale", "grid", "grid")
    form = "^rmat_s(\\d+)_e16\\.balanced(\\d+)x(\\d+)\\.mtx$"
    cases = log.select("run_id", name.alias("file")).where(F.col("file").rlike(form)).select(
        "run_id", *[F.regexp_extract("file", form, i + 1).cast("bigint").alias(c) for i, c in enumerate(("scale", "grid"))]
    )
    stale = spark.createDataFrame([(12, 64)], "scale bigint, grid bigint")
    return cases.join(F.broadcast(stale), ["scale", "grid"], "left_anti").select("run_id", "scale", "grid")


@_query("gteps", f"{_LOG} SELECT run_id, round({_RATE}, 9) AS gteps FROM log")
def gteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.run_log(spark, sf_dir).select("run_id", F.round(units.gteps(F.col("m"), _net()), 9).alias("gteps"))


@_query("pct_communication", f"{_LATEST} SELECT scale, grid, round({_PCT}, 6) AS pct FROM latest")
def pct_communication(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = units.total(units.cycles(F.col("compute"))) + units.total(units.cycles(F.col("term")))
    share = F.when(_net() > 0, (_net() - busy).cast("double") / _net() * 100)
    return _latest_runs(spark, sf_dir).select("scale", "grid", F.round(share, 6).alias("pct"))


_CELLS = f"cells AS (SELECT scale, grid, round({_RATE}, 9) AS g FROM latest)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round(units.gteps(F.col("m"), _net()), 9)
    return _latest_runs(spark, sf_dir).select("scale", "grid", rate.alias("g"))


@_query("scale_grid_pivot", f"{_LATEST}, {_CELLS} SELECT scale, " + ", ".join(f"max(g) FILTER (grid = {g}) AS g{g}" for g in derived.GRIDS) + " FROM cells GROUP BY scale")
def scale_grid_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _cells(spark, sf_dir).groupBy("scale").pivot("grid", list(derived.GRIDS)).agg(F.max("g"))
    return wide.select("scale", *[F.col(str(g)).alias(f"g{g}") for g in derived.GRIDS])


@_query("best_grid_per_scale", f"{_LATEST}, {_CELLS} SELECT scale, arg_max(grid, g) AS best_grid, max(g) AS best FROM cells WHERE g IS NOT NULL GROUP BY scale")
def best_grid_per_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _cells(spark, sf_dir).where("g IS NOT NULL")
    return known.groupBy("scale").agg(F.max_by("grid", "g").alias("best_grid"), F.max("g").alias("best"))


@_query("first_grid_per_scale", f"{_LATEST}, {_CELLS} SELECT scale, min(grid) AS first_grid FROM cells WHERE g IS NOT NULL GROUP BY scale")
def first_grid_per_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).where("g IS NOT NULL").groupBy("scale").agg(F.min("grid").alias("first_grid"))


_PER_ROUND = """per AS (SELECT run_id, scale, grid, total_cycles, resolve_cycles, unnest(range(4)) AS round, unnest(string_split(compute, ';')::BIGINT[]) AS c,
    unnest(string_split(term, ';')::BIGINT[]) AS t, unnest(string_split(duration, ';')::BIGINT[]) AS d FROM log)"""


def _per_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = F.arrays_zip(*[units.cycles(F.col(c)).alias(c[0]) for c in ("compute", "term", "duration")])
    log = derived.run_log(spark, sf_dir).select("run_id", "scale", "grid", "total_cycles", "resolve_cycles", F.posexplode(zipped).alias("round", "x"))
    return log.select("run_id", "scale", "grid", "total_cycles", "resolve_cycles", F.col("round").cast("bigint").alias("round"), F.col("x.c").alias("c"), F.col("x.t").alias("t"), F.col("x.d").alias("d"))


@_query("round_cycles_explode", f"{_LOG}, {_PER_ROUND} SELECT run_id, round, c AS compute, t AS term, greatest(d - c - t, 0) AS communication FROM per")
def round_cycles_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.greatest(F.col("d") - F.col("c") - F.col("t"), F.lit(0))
    return _per_round(spark, sf_dir).select("run_id", "round", F.col("c").alias("compute"), F.col("t").alias("term"), rest.alias("communication"))


@_query("round_lists", f"{_LOG} SELECT run_id, {_SUM.format('compute')}::BIGINT AS total_compute, len(string_split(term, ';')) AS n_rounds, compute AS compute_text FROM log")
def round_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = units.cycles(F.col("compute"))
    return derived.run_log(spark, sf_dir).select(
        "run_id", units.total(values).alias("total_compute"), F.size(units.cycles(F.col("term"))).cast("bigint").alias("n_rounds"), units.joined(values).alias("compute_text")
    )


def _mean_std_sql(value: str) -> str:
    return f"count(*) AS n_runs, round(avg({value}), 9) AS mean_value, round(coalesce(stddev_samp({value}), 0), 9) AS std_value"


@_query("run_mean_std", f"{_LOG} SELECT scale, grid, {_mean_std_sql(f'total_cycles::DOUBLE / {CLOCK} * 1000')} FROM log GROUP BY scale, grid")
def run_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.mean_std(derived.run_log(spark, sf_dir), ["scale", "grid"], units.milliseconds(F.col("total_cycles")))


@_query("round_stack_mean_std", f"{_LOG}, {_PER_ROUND} SELECT scale, round, {_mean_std_sql(f'greatest(d - c - t, 0)::DOUBLE / {CLOCK} * 1000')} FROM per GROUP BY scale, round")
def round_stack_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.greatest(F.col("d") - F.col("c") - F.col("t"), F.lit(0))
    return telemetry.mean_std(_per_round(spark, sf_dir), ["scale", "round"], units.milliseconds(rest))


@_query("run_totals_mean_std", f"""{_LOG}, {_PER_ROUND}, tot AS (SELECT run_id, scale, sum(c + t)::BIGINT AS busy FROM per GROUP BY ALL)
    SELECT scale, {_mean_std_sql(f'busy::DOUBLE / {CLOCK} * 1000')} FROM tot GROUP BY scale""")
def run_totals_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _per_round(spark, sf_dir).groupBy("run_id", "scale").agg(F.sum(F.col("c") + F.col("t")).alias("busy"))
    return telemetry.mean_std(totals, ["scale"], units.milliseconds(F.col("busy")))


@_query("communication_check", f"""{_LOG}, {_PER_ROUND}, s AS (SELECT run_id AS run, sum(greatest(d - c - t, 0))::BIGINT AS summed, (max(total_cycles) // 300 - sum(c + t) - 7)::BIGINT AS implied FROM per GROUP BY run_id)
    SELECT run, summed, implied, summed - implied AS delta, greatest(floor(0.05 * abs(implied)), 1000)::BIGINT AS tolerance, abs(summed - implied) <= greatest(floor(0.05 * abs(implied)), 1000) AS ok FROM s""")
def communication_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_round(spark, sf_dir).select(F.col("run_id").alias("run"), F.col("d").alias("duration"), (F.col("c") + F.col("t")).alias("compute"), "total_cycles")
    return telemetry.communication_check(rows, F.expr("total_cycles div 300"), F.lit(7))


@_query("rate_summary_by_grid", f"{_LOG} SELECT grid, {_RATES} FROM (SELECT grid, CASE WHEN x > 0 THEN x END AS g FROM (SELECT grid, {_RATE} AS x FROM log)) GROUP BY grid")
def rate_summary_by_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = derived.run_log(spark, sf_dir).select("grid", units.gteps(F.col("m"), _net()).alias("gteps"))
    return telemetry.rate_summary(rates, keys=("grid",))


# ---- files and tables of runs ----


@_query("results_csv_scan", f"{_LOG} SELECT run_id, scale, grid, total_cycles, resolve_cycles, m, compute, term, duration FROM log")
def results_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "results-csv")
    results.write_results(derived.run_log(spark, sf_dir), path)
    kept_until_exit(spark, path)
    return results.read_results(spark, path, derived.run_log(spark, sf_dir).schema).drop("ts")


@_query("run_log_rows", f"{_LOG} SELECT run_id, total_cycles FROM log WHERE scale = 12 AND grid = 64")
def run_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.of_case(derived.run_log(spark, sf_dir), {"scale": 12, "grid": 64}).select("run_id", "total_cycles")


@_query("run_metadata", "SELECT event_id AS run_id, (props->>'$.k')::BIGINT AS k FROM events")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "metadata")
    found = derived.table(spark, sf_dir, "events")
    found.select(F.to_json(F.struct(F.col("event_id").alias("run_id"), F.from_json("props", "k bigint").alias("props"))).alias("value")).write.text(path)
    kept_until_exit(spark, path)
    return results.read_metadata(spark, path, "run_id bigint, props struct<k: bigint>").select("run_id", "props.k")


@_query("phase_table", f"SELECT l_orderkey AS run, round, row_b, col_b, 'compute' AS phase, t_end - t_start AS cycles FROM ({TICKS_SQL})")
def phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "phases")
    ticks = decode_timestamps(spark, sf_dir).select(F.col("l_orderkey").alias("run"), "round", "row_b", "col_b", F.col("cycles").alias("compute"))
    results.write_phases(ticks, ["run", "round", "row_b", "col_b"], ["compute"], path)
    kept_until_exit(spark, path)
    return results.read_phases(spark, path)


@_query("block_structure", f"{_with('purchases', _BLK)} SELECT row_b, col_b, count(*) AS nnz, count(DISTINCT col_l) AS nz_cols, count(DISTINCT row_l) AS nz_rows FROM blk GROUP BY ALL")
def block_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.nz_lines_per_block(*_blocks(spark, sf_dir), GRID)
