"""Timing tables: ticks to phases, phases to rounds, rounds to spans, and the summaries of searches."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latticework.functions.units import decode_ticks


def decoded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, t_start, t_end and cycles of rows with words s0-s2 and e0-e2."""
    start, end = (decode_ticks(*[F.col(f"{p}{i}") for i in range(3)]) for p in "se")
    return rows.select(*keys, start.alias("t_start"), end.alias("t_end")).withColumn("cycles", F.col("t_end") - F.col("t_start"))


def phase_stats(phases: DataFrame) -> DataFrame:
    """(phase, round, min, max and avg of cycles) over all elements."""
    return phases.groupBy("phase", "round").agg(
        F.min("cycles").alias("min_cycles"), F.max("cycles").alias("max_cycles"), F.round(F.avg("cycles"), 1).alias("avg_cycles")
    )


def round_duration(rounds: DataFrame) -> DataFrame:
    """(round, duration): the slowest element's span, a round ends for all together."""
    return rounds.groupBy("round").agg(F.max(F.col("t_end") - F.col("t_start")).alias("duration"))


def sync_span(marks: DataFrame, width: int) -> DataFrame:
    """(run, span): last toc minus first tic after moving every clock to the pulse's origin.

    The pulse starts in the middle column and takes one tick a hop.
    """
    zero = F.col("ref") - F.abs(F.col("col_b") - width // 2)
    return marks.groupBy("run").agg((F.max(F.col("toc") - zero) - F.min(F.col("tic") - zero)).alias("span"))


def self_delta(marks: DataFrame) -> DataFrame:
    """(run, longest): the largest toc - tic of a single element, a lower bound of the span."""
    return marks.groupBy("run").agg(F.max(F.col("toc") - F.col("tic")).alias("longest"))


def switch_round(rounds: DataFrame) -> DataFrame:
    """(source, switch_round): the first bottom-up round, null without one."""
    return rounds.groupBy("source").agg(F.min(F.when(F.col("direction") == "bottom_up", F.col("round"))).alias("switch_round"))


def communication_check(rounds: DataFrame, device_time: Column, transpose: Column) -> DataFrame:
    """(run, summed, implied, delta, tolerance, ok) of rounds(run, duration, compute).

    Communication summed over rounds against the whole run's remainder; they may
    differ by a twentieth, or 1000 cycles.
    """
    left = F.greatest(F.col("duration") - F.col("compute"), F.lit(0))
    sums = rounds.groupBy("run").agg(
        F.sum(left).cast("bigint").alias("summed"), F.sum("compute").cast("bigint").alias("compute"), F.max(device_time).alias("device"), F.max(transpose).alias("transpose")
    )
    implied = F.col("device") - F.col("compute") - F.col("transpose")
    return (
        sums.select("run", "summed", implied.cast("bigint").alias("implied"))
        .withColumn("delta", F.col("summed") - F.col("implied"))
        .withColumn("tolerance", F.greatest(F.floor(0.05 * F.abs("implied")), F.lit(1000)).cast("bigint"))
        .withColumn("ok", F.abs("delta") <= F.col("tolerance"))
    )


def rounds_check(rounds: DataFrame, searches: DataFrame, tolerance: float = 0.05, least: float = 1.0) -> DataFrame:
    """(search_idx, n_rounds, summed, total, delta, ok): a search's measured rounds against its whole time.

    ``rounds(search_idx, started, ended)`` and ``searches(search_idx, search_time_seconds)``. Rounds may
    not overlap, nor take longer than the search together; what lies outside them (the start, the
    stored result) may be up to ``tolerance`` of the time, or ``least`` seconds.
    """
    sums = rounds.groupBy("search_idx").agg(F.count("*").alias("n_rounds"), F.sum(F.col("ended") - F.col("started")).alias("summed"), (F.max("ended") - F.min("started")).alias("span"))
    both = sums.join(searches.select("search_idx", F.col("search_time_seconds").alias("total")), "search_idx").withColumn("delta", F.col("total") - F.col("summed"))
    room = F.greatest(F.lit(tolerance) * F.col("total"), F.lit(least))
    apart = F.col("summed") <= F.col("span") + 1e-6
    return both.select("search_idx", "n_rounds", "summed", "total", "delta", (apart & (F.abs("delta") <= room)).alias("ok"))


def rate_summary(searches: DataFrame, rate: str = "gteps", keys: tuple[str, ...] = ()) -> DataFrame:
    """Searches, usable rates, and their harmonic mean, minimum, median and maximum.

    Rates that are null, not finite or not positive count as searches only.
    """
    usable = F.when((F.col(rate) > 0) & ~F.isnan(rate) & (F.col(rate) < float("inf")), F.col(rate))
    return searches.groupBy(*keys).agg(
        F.count("*").alias("num_searches"),
        F.count(usable).alias("num_rates"),
        F.round(F.count(usable) / F.sum(1.0 / usable), 9).alias("harmonic_mean"),
        F.round(F.min(usable), 9).alias("min_rate"),
        F.round(F.percentile(usable, 0.5), 9).alias("median_rate"),
        F.round(F.max(usable), 9).alias("max_rate"),
    )


def mean_std(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Mean and sample standard deviation; 0 for a single row."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_runs"),
        F.round(F.avg(value), 9).alias("mean_value"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 9).alias("std_value"),
    )


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: later log rows supersede earlier ones."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(at)).where("_at = 1").drop("_at")


def of_case(rows: DataFrame, case: dict[str, object]) -> DataFrame:
    """All rows of one case, told by the values of its columns; ``latest`` gives the last one of each."""
    for column, value in case.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows


def pending(planned: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cases that no log row has."""
    return planned.join(log.select(*keys).distinct(), keys, "left_anti")


@dataclass
class Stopwatch:
    """Seconds by stage of a run, as rows of a table."""

    spans: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def stage(self, name: str):  # noqa: ANN201
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans.append((name, time.perf_counter() - began))

    def timed(self, name: str, work: Callable[[], object]) -> object:
        with self.stage(name):
            return work()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.spans, "stage string, seconds double")
