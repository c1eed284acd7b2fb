"""R-MAT graphs: an exact mode that follows numpy's stream, and a hashed mode that SQL can repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.edges import symmetrize

#: The quadrant probabilities of the benchmark's generator, summed up.
QUADRANTS = (0.57, 0.76, 0.95)


def raw_edges(spark: SparkSession, scale: int, edge_factor: int, seed: int, slice_rows: int = 1 << 18) -> DataFrame:
    """(src, dst) per drawn edge. Level l of edge i uses draw l * m + i of ``default_rng(seed)``.

    Slices jump to their part of the stream, so generation is parallel and exact.
    """
    m = (1 << scale) * edge_factor
    starts = spark.range(0, m, slice_rows, numPartitions=max(1, -(-m // slice_rows)))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in frame["id"]:
                count = min(slice_rows, m - start)
                u, v = np.zeros(count, np.int64), np.zeros(count, np.int64)
                for level in range(scale):
                    stream = np.random.PCG64(np.random.SeedSequence(seed)).advance(level * m + int(start))
                    quadrant = np.searchsorted(QUADRANTS, np.random.Generator(stream).random(count), side="right")
                    u = 2 * u + (quadrant >= 2)
                    v = 2 * v + (quadrant % 2)
                yield pd.DataFrame({"src": v, "dst": u})

    return starts.mapInPandas(draw, "src bigint, dst bigint")


def rmat(spark: SparkSession, scale: int, edge_factor: int, seed: int = 0) -> DataFrame:
    """The undirected simple graph of the drawn edges."""
    return symmetrize(raw_edges(spark, scale, edge_factor, seed))


def hashed_rmat(spark: SparkSession, scale: int, edge_factor: int, seed: int) -> DataFrame:
    """The same distribution with md5 of ``seed:edge:level`` for the draws; one narrow pass."""
    cuts = [int(round(2**32 * q)) for q in QUADRANTS]
    levels = F.sequence(F.lit(0), F.lit(scale - 1))

    def draw(level: F.Column) -> F.Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), level.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    drawn = spark.range((1 << scale) * edge_factor).select(F.transform(levels, draw).alias("r"))

    def bits(test) -> F.Column:  # noqa: ANN001
        return F.aggregate("r", F.lit(0).cast("bigint"), lambda acc, r: acc * 2 + F.when(test(r), 1).otherwise(0))

    high = bits(lambda r: r >= cuts[1])
    low = bits(lambda r: ((r >= cuts[0]) & (r < cuts[1])) | (r >= cuts[2]))
    return symmetrize(drawn.select(high.alias("src"), low.alias("dst")))
