"""Column functions for ticks, rates and lists kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the clock that cycles are converted with.
CLOCK_HZ = 875_000_000


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b)


def decode_ticks(w0: Column, w1: Column, w2: Column) -> Column:
    """A 48-bit count from three 16-bit words, lowest first."""
    return w0.cast("bigint") + F.shiftleft(w1.cast("bigint"), 16) + F.shiftleft(w2.cast("bigint"), 32)


def encode_ticks(ticks: Column) -> list[Column]:
    return [F.shiftright(ticks, 16 * i).bitwiseAND(F.lit(65535)) for i in range(3)]


def cycles(text: Column) -> Column:
    """array<bigint> of a ``;``-joined list; blank parts are skipped."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: F.trim(x) != ""), lambda x: x.cast("bigint"))


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ";")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def seconds(of_cycles: Column, clock_hz: int = CLOCK_HZ) -> Column:
    return of_cycles.cast("double") / clock_hz


def milliseconds(of_cycles: Column, clock_hz: int = CLOCK_HZ) -> Column:
    return seconds(of_cycles, clock_hz) * 1000.0


def gteps(m: Column, of_cycles: Column, clock_hz: int = CLOCK_HZ) -> Column:
    """10^9 edges a second; null where no time passed."""
    return F.when(of_cycles > 0, m / seconds(of_cycles, clock_hz) / 1e9)
