"""Graphs and logs derived from the driver's tables, as Spark plans and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.units import CLOCK_HZ, encode_ticks
from latticework.sources.rmat import hashed_rmat


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both_ways(one: DataFrame) -> DataFrame:
    """Every edge and its mirror, from one pass over ``one``: a union would make its rows twice."""
    return one.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) and the parts they bought (odd ids), symmetric and distinct. Lines pass a hash of the orders unsorted."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = orders.hint("shuffle_hash").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return _both_ways(joined.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")).distinct())


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) and their orders (odd ids), symmetric: sparse, one component per customer."""
    return _both_ways(table(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst")))


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed paths of the consecutive events of each user."""
    following = F.expr("lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), following.alias("dst")).where("dst IS NOT NULL")


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same paths, symmetric."""
    return _both_ways(event_steps(spark, sf_dir))


def small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hashed R-MAT graph of 256 vertices."""
    return hashed_rmat(spark, 8, 4, 7)


def multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed, with repeated edges and self-loops."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select((F.col("o_custkey") % 60).alias("src"), (F.col("l_partkey") % 60).alias("dst"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, target) of href attributes."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target"))


GRIDS = (4, 8, 16, 32, 64, 128, 256, 512, 750)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark log with one run per order; per-round lists are text."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def series(step: int, plus: int) -> Column:
        return F.concat_ws(";", *[((key * (k + step)) % 1000 + plus).cast("string") for k in range(4)])

    grid = F.element_at(F.array(*[F.lit(g) for g in GRIDS]), (key % len(GRIDS) + 1).cast("int"))
    price = F.floor("o_totalprice").cast("bigint")
    return o.select(
        key.alias("run_id"),
        F.col("o_orderdate").alias("ts"),
        (cust % 11 + 10).cast("bigint").alias("scale"),
        grid.cast("bigint").alias("grid"),
        (price * 10 + 20000).alias("total_cycles"),
        (cust * 30).alias("resolve_cycles"),
        (key * 50 + 1000).alias("m"),
        series(3, 100).alias("compute"),
        series(7, 50).alias("term"),
        F.concat_ws(";", *[((key * (k + 3)) % 1000 + (key * (k + 7)) % 1000 + 150 + (cust * (k + 1)) % 500 - 100).cast("string") for k in range(4)]).alias("duration"),
    )


def tick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end ticks of elements as words: one per line item."""
    start = F.col("l_orderkey") * 4_000_003 + F.col("l_linenumber") * 17 + F.col("l_suppkey")
    end = start + F.col("l_partkey") * 40 + F.floor("l_quantity").cast("bigint")
    words = [w.alias(f"{p}{i}") for p, t in (("s", start), ("e", end)) for i, w in enumerate(encode_ticks(t))]
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") - 1).cast("int").alias("round"), (F.col("l_suppkey") % 8).alias("row_b"), (F.col("l_partkey") % 8).alias("col_b"), *words
    )


def sync_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tic, toc and reference ticks of elements by run."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.concat("l_returnflag", "l_linestatus").alias("run"),
        (F.col("l_partkey") % 8).alias("col_b"),
        (F.col("l_orderkey") % 1000 + 5000).alias("tic"),
        (F.col("l_orderkey") % 1000 + 5000 + F.col("l_partkey")).alias("toc"),
        (F.col("l_suppkey") % 100 + F.abs(F.col("l_partkey") % 8 - 4)).alias("ref"),
    )


_JOINED = "orders JOIN lineitem ON l_orderkey = o_orderkey"
_BOTH = "SELECT c AS src, p AS dst FROM g UNION ALL SELECT p, c FROM g"
_STEPS = "SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"

#: name: SQL of ``e(src, dst)``
GRAPH_SQL = {
    "purchases": f"WITH g AS (SELECT DISTINCT 2 * o_custkey AS c, 2 * l_partkey + 1 AS p FROM {_JOINED}) {_BOTH}",
    "customer_orders": f"WITH g AS (SELECT 2 * o_custkey AS c, 2 * o_orderkey + 1 AS p FROM orders) {_BOTH}",
    "event_steps": f"SELECT src, dst FROM ({_STEPS}) WHERE dst IS NOT NULL",
    "event_paths": f"WITH s AS (SELECT src, dst FROM ({_STEPS}) WHERE dst IS NOT NULL) SELECT src, dst FROM s UNION ALL SELECT dst, src FROM s",
    "small_world": """WITH d AS (SELECT i, l, ('0x' || substr(md5('7:' || i || ':' || l), 1, 8))::BIGINT AS r FROM range(1024) a(i), range(8) b(l)),
        w AS (SELECT i, sum(CASE WHEN r >= 3264175145 THEN 1 << (7 - l) ELSE 0 END)::BIGINT AS u,
                     sum(CASE WHEN (r >= 2448131359 AND r < 3264175145) OR r >= 4080218931 THEN 1 << (7 - l) ELSE 0 END)::BIGINT AS v FROM d GROUP BY i)
        SELECT u AS src, v AS dst FROM w WHERE u <> v UNION SELECT v, u FROM w WHERE u <> v""",
    "multigraph": f"SELECT o_custkey % 60 AS src, l_partkey % 60 AS dst FROM {_JOINED}",
}

_GRID_LIST = ", ".join(map(str, GRIDS))


def _series_sql(step: int, plus: int) -> str:
    return " || ';' || ".join(f"((o_orderkey * {k + step}) % 1000 + {plus})::VARCHAR" for k in range(4))


_DURATION = " || ';' || ".join(
    f"((o_orderkey * {k + 3}) % 1000 + (o_orderkey * {k + 7}) % 1000 + 150 + (o_custkey * {k + 1}) % 500 - 100)::VARCHAR" for k in range(4)
)

RUN_LOG_SQL = f"""SELECT o_orderkey AS run_id, o_orderdate AS ts, (o_custkey % 11 + 10)::BIGINT AS scale, ([{_GRID_LIST}])[(o_orderkey % {len(GRIDS)} + 1)::INT]::BIGINT AS grid,
    floor(o_totalprice)::BIGINT * 10 + 20000 AS total_cycles, o_custkey * 30 AS resolve_cycles, o_orderkey * 50 + 1000 AS m,
    {_series_sql(3, 100)} AS compute, {_series_sql(7, 50)} AS term, {_DURATION} AS duration FROM orders"""

TICKS_SQL = """SELECT l_orderkey, (l_linenumber - 1)::INT AS round, l_suppkey % 8 AS row_b, l_partkey % 8 AS col_b,
    l_orderkey * 4000003 + l_linenumber * 17 + l_suppkey AS t_start,
    l_orderkey * 4000003 + l_linenumber * 17 + l_suppkey + l_partkey * 40 + floor(l_quantity)::BIGINT AS t_end FROM lineitem"""

MARKS_SQL = """SELECT l_returnflag || l_linestatus AS run, l_partkey % 8 AS col_b, l_orderkey % 1000 + 5000 AS tic, l_orderkey % 1000 + 5000 + l_partkey AS toc,
    l_suppkey % 100 + abs(l_partkey % 8 - 4) AS ref FROM lineitem"""

CLOCK = CLOCK_HZ
