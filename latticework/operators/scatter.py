"""Random relabelling of vertices, by a keyed bijection that is computed row by row.

A permutation by sorting random numbers shuffles all vertices, and relabelling by it joins
the edges twice. Here the new id is a function of the old one: rounds of swapping or not.
In a round with secret k, x and (k - x) mod n are partners; a bit mixed from the larger of
the two says for both whether they swap. Each round is its own inverse and maps range(n)
onto itself for every n, so neither a table nor walking along cycles is needed, and the
inverse is the rounds in reverse. Edges are relabelled where they are read, without a shuffle.

It is the load baseline that balancers are held against, and no cipher. A null id stays null;
ids outside range(n) are the caller's error and may collide; with n of 1 or less nothing moves.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 24
MODULUS = 2**31 - 1
#: Multipliers that generate all residues of MODULUS.
FIRST, SECOND = 48271, 16807
#: Ids that go through all rounds at a time, few enough to stay in a core's cache.
CHUNK = 1 << 13


def secrets(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One number below 2**61 a round."""
    draw = random.Random(seed)
    return [draw.randrange(2**61) for _ in range(rounds)]


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """Bring x, at most 63 bits, nearer to its rest by MODULUS, without a division: 2**31 is 1."""
    np.right_shift(x, 31, out=spare)
    np.bitwise_and(x, MODULUS, out=x)
    np.add(x, spare, out=x)


def _rounds(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """``x`` after all rounds. Products stay below 2**63: what one folding leaves of 63 bits is below 2**33, of 48 bits below 2**31 + 2**17."""
    x, partner, bit, spare = x.copy(), np.empty_like(x), np.empty_like(x), np.empty_like(x)
    for secret in keys:
        np.subtract(secret % n, x, out=partner)
        np.right_shift(partner, 63, out=spare)
        np.bitwise_and(spare, n, out=spare)
        np.add(partner, spare, out=partner)
        np.maximum(x, partner, out=bit)
        if n > MODULUS:
            high = bit >> 31
            _fold(high, spare)
            _fold(high, spare)
            _fold(bit, spare)
            bit += high * SECOND
            _fold(bit, spare)
        bit += secret % MODULUS
        bit *= FIRST
        _fold(bit, spare)
        bit *= bit
        bit += secret % MODULUS
        _fold(bit, spare)
        bit *= SECOND
        _fold(bit, spare)
        _fold(bit, spare)
        bit -= MODULUS * (bit >= MODULUS)
        bit >>= 16
        bit &= 1
        # x and partner are exchanged where the bit is 1
        np.negative(bit, out=bit)
        partner ^= x
        partner &= bit
        x ^= partner
    return x


def scattered(vertex: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """The vertex's id under the permutation of range(n) that ``seed`` draws, or with ``inverse`` its id before.

    The rounds run over Arrow batches in numpy: as a Spark expression they would be interpreted, step by step.
    """
    if n < 2:
        return vertex.cast("bigint")
    keys = secrets(seed)[:: -1 if inverse else 1]

    def run(ids: pa.Array) -> pa.Array:
        x = ids.fill_null(0).to_numpy(zero_copy_only=False)
        parts = [_rounds(x[at : at + CHUNK], n, keys) for at in range(0, len(x), CHUNK)]
        return pa.array(np.concatenate(parts) if parts else x, pa.int64(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "bigint")(vertex.cast("bigint"))


def scatter(edges: DataFrame, n: int, seed: int, inverse: bool = False) -> DataFrame:
    """edges(src, dst) under random labels, or back from them: one narrow pass."""
    return edges.select(*[scattered(F.col(c), n, seed, inverse).alias(c) for c in ("src", "dst")])


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """perm(old_id, new_id) of range(n), for writers and operators that take a table."""
    return spark.range(n).select(F.col("id").alias("old_id"), scattered(F.col("id"), n, seed).alias("new_id"))


def scattered_sql(vertex: str, n: str, seed: int) -> str:
    """The same id as a DuckDB expression."""
    partner = f"((s % {n} - x) % {n} + {n}) % {n}"
    big = f"greatest(x, {partner})"
    once = f"(({big} % {MODULUS} + ({big} >> 31) % {MODULUS} * {SECOND} + s % {MODULUS}) % {MODULUS} * {FIRST} % {MODULUS})"
    bit = f"(({once} * {once} + s % {MODULUS}) % {MODULUS} * {SECOND} % {MODULUS} >> 16) % 2"
    return f"list_reduce({secrets(seed)}, lambda x, s: CASE WHEN {bit} = 1 THEN {partner} ELSE x END, {vertex})"
