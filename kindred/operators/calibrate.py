"""A distance threshold from the number of matches wanted for each name."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.matching import name_pairs, vector_pairs

#: Rows of either side that are compared at most, and the least threshold.
SAMPLE, LEAST = 1000, 1e-6


def _sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """SAMPLE rows by a hash of their values and the seed, whatever the partitions; a smaller table whole."""
    if n <= SAMPLE:
        return df
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    return df.orderBy(h, *[F.col(f"`{c}`") for c in df.columns]).limit(SAMPLE)


def _quantile(distances: DataFrame, share: float) -> float:
    """The linearly interpolated quantile of finite distances d that stand for n pairs each; infinite if there is none."""
    finite = distances.where(F.col("d").isNotNull() & ~F.isnan("d") & (F.col("d") < float("inf")))
    t = finite.agg(F.percentile("d", min(1.0, share), F.col("n")).alias("t")).first().t
    return math.inf if t is None else max(abs(t), LEAST)


def share_of_pairs(target: float, nx: int, ny: int) -> float:
    return target / math.sqrt(nx * ny)


def name_threshold(left: DataFrame, right: DataFrame, left_name: str, right_name: str, target: float, distance: str = "jaccard", q: int = 2, seed: int = 0) -> float:
    """The quantile of candidates' distances that target / sqrt(rows of left * rows of right) reaches.

    Up to 1000 rows of either side are drawn; smaller tables are used whole, and the result is then the same each time.
    Distances are over distinct names, weighted by the rows that have them.
    """
    nx, ny = left.count(), right.count()
    if not nx or not ny:
        return math.inf
    x = _sample(left.select(F.col(f"`{left_name}`").alias("a")), nx, seed).groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    y = _sample(right.select(F.col(f"`{right_name}`").alias("b")), ny, seed + 1).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    probe = "right" if min(ny, SAMPLE) < min(nx, SAMPLE) else "left"
    held = max(nx, ny) > SAMPLE and not _can_checkpoint(x)
    if held:
        x, y = x.persist(), y.persist()
    elif max(nx, ny) > SAMPLE:
        x, y = x.checkpoint(), y.checkpoint()
    pairs = name_pairs(x, y, "a", "b", distance, q, probe=probe)
    weighted = pairs.join(x, F.col("left_name") == F.col("a")).join(y, F.col("right_name") == F.col("b"))
    try:
        return _quantile(weighted.select(F.col("stringdist").alias("d"), (F.col("m") * F.col("n")).alias("n")), share_of_pairs(target, nx, ny))
    finally:
        if held:
            x.unpersist(), y.unpersist()


def vector_threshold(left: DataFrame, right: DataFrame, left_vector: str, right_vector: str, target: float, metric: str | Callable = "euclidean", seed: int = 0) -> float:
    """The same over all pairs of embeddings of the sample."""
    nx, ny = left.count(), right.count()
    if not nx or not ny:
        return math.inf
    x = _sample(left.select(F.col(f"`{left_vector}`").alias("v")), nx, seed).withColumn("i", F.monotonically_increasing_id())
    y = _sample(right.select(F.col(f"`{right_vector}`").alias("v")), ny, seed + 1).withColumn("i", F.monotonically_increasing_id())
    pairs = vector_pairs(x, y, "i", "i", "v", "v", None, metric)
    return _quantile(pairs.select(F.col("stringdist").alias("d"), F.lit(1).alias("n")), share_of_pairs(target, nx, ny))


def threshold(left: DataFrame, right: DataFrame, left_column: str, right_column: str, target: float = 5, mode: str = "euclidean", **options) -> float:
    """Either of them: mode is discrete (columns of names) or euclidean (columns of embeddings)."""
    if mode == "discrete":
        return name_threshold(left, right, left_column, right_column, target, **options)
    if mode == "euclidean":
        return vector_threshold(left, right, left_column, right_column, target, **options)
    raise ValueError(f"mode is discrete or euclidean, not {mode!r}")


def _can_checkpoint(df: DataFrame) -> bool:
    return bool(df.sparkSession.sparkContext.getCheckpointDir())
