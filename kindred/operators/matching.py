"""Pairs of names within a string distance, and of embeddings within a vector distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kindred.functions.distance import BY_LENGTH, name_distance
from kindred.functions.shipping import ship
from kindred.operators.blocking import candidates, similar_candidates
from kindred.operators.vector_blocks import BLOCK, OUT, block_pairs, each_pair, joined, near, symmetric

#: Jaccard similarity from which pairs meet by prefixes of their q-grams, not by all trigrams. Both ways give the same.
LEAST_SIMILAR = 0.5


def name_pairs(left: DataFrame, right: DataFrame, left_name: str, right_name: str, distance: str = "jaccard", q: int = 2, blocking: str = "trigram", probe: str | None = None, max_dist: float | None = None) -> DataFrame:
    """left, right -> left_name, right_name, stringdist over distinct names; null distances stay unless max_dist is given.

    probe: which side is the smaller table, left or right; counted if None (ties: left). blocking none compares all pairs.
    """
    x = left.select(F.col(f"`{left_name}`").alias("name")).where("name is not null")
    y = right.select(F.col(f"`{right_name}`").alias("name")).where("name is not null")
    if blocking == "none":
        pairs = x.distinct().select(F.col("name").alias("left_name")).crossJoin(y.distinct().select(F.col("name").alias("right_name")))
    elif blocking == "trigram":
        probe = probe or smaller(left, right)
        sides = (x, y) if probe == "left" else (y, x)
        strict = distance == "jaccard" and max_dist is not None and max_dist <= 1 - LEAST_SIMILAR
        pairs = similar_candidates(*sides, q, 1 - max_dist) if strict else candidates(*sides)
        pairs = pairs.select(F.col("probe" if probe == "left" else "other").alias("left_name"), F.col("other" if probe == "left" else "probe").alias("right_name"))
    else:
        raise ValueError(f"blocking is trigram or none, not {blocking!r}")
    if max_dist is not None and distance in BY_LENGTH:
        pairs = pairs.where(F.abs(F.length("left_name") - F.length("right_name")) <= max_dist)
    pairs = pairs.withColumn("stringdist", name_distance(distance, F.col("left_name"), F.col("right_name"), q))
    return pairs if max_dist is None else pairs.where(within("stringdist", max_dist))


def within(column: str, max_dist: float):
    return (F.col(column) <= F.lit(float(max_dist))) & ~F.isnan(column)


def smaller(left: DataFrame, right: DataFrame) -> str:
    """The side of fewer rows; left if both have as many."""
    return "right" if right.count() < left.count() else "left"


def vector_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vector: str, right_vector: str, max_dist: float | None = None, metric: str | Callable = "euclidean", block: int = BLOCK) -> DataFrame:
    """left, right -> left_id, right_id, stringdist for pairs at most max_dist apart (None: all pairs but undefined ones).

    The task is all pairs by its definition. Both sides are packed into blocks once; a task computes pairs of blocks as matrix
    products, so its memory is bounded, and nothing but the packing is shuffled. A table against itself takes half of the
    pairs where the distance is the same both ways.
    metric: euclidean, rmse_eps, or a function of a vector and a matrix of vectors that returns their distances. Distances
    that the matrix product brings out within rounding of the threshold are computed again as a sum of squares.
    A function may state by attributes that it is symmetric (bool), and give lower bounds at_least(u, v) of the distances
    of all rows of two matrices, such as manhattan_at_least; it is then called for pairs alone whose bound is within max_dist.
    """
    x, y = (df.where(F.col(f"`{i}`").isNotNull()) for df, i in ((left, left_id), (right, right_id)))
    same = symmetric(metric) and (left_id, left_vector) == (right_id, right_vector) and (left is right or left.sameSemantics(right))
    pairs = block_pairs(x, y, (F.col(f"`{left_id}`"), F.col(f"`{right_id}`")), (F.col(f"`{left_vector}`"), F.col(f"`{right_vector}`")), same, block)
    kinds = [pairs.schema[f"{side}_carry"].dataType.elementType for side in "lr"]
    schema = StructType([StructField("left_id", kinds[0]), StructField("right_id", kinds[1]), StructField("stringdist", DoubleType())])
    return pairs.mapInArrow(_found(metric, float("inf") if max_dist is None else max_dist, same), schema)


def _found(metric: str | Callable, limit: float, same: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for own, x, y, u, v in each_pair(batches):
            for i, j, d in near(u, v, metric, limit):
                a, b, d = x.take(pa.array(i)), y.take(pa.array(j)), pa.array(d)
                for one, other in ((a, b), (b, a))[: 2 if same and not own else 1]:
                    held.append(pa.RecordBatch.from_arrays([one, other, d], names=["left_id", "right_id", "stringdist"]))
                if sum(len(h) for h in held) >= OUT:
                    yield from joined(held)
                    held = []
        yield from joined(held)

    return run


def impute_column_means(rows: DataFrame, vector: str) -> DataFrame:
    """Null and NaN components become the mean of the others at their place; places without any value become null."""
    v = F.col(f"`{vector}`").cast("array<double>")
    known = lambda x: F.when(~F.isnan(x), x)
    places = rows.select(F.posexplode(v).alias("at", "x")).groupBy("at").agg(F.avg(known(F.col("x"))).alias("mean"))
    means = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda s: s["mean"]).alias("means_"))  # one row of as many numbers as places
    filled = F.transform(v, lambda x, i: F.coalesce(known(x), F.get(F.col("means_"), i)))
    return rows.crossJoin(F.broadcast(means)).withColumn(vector, filled).drop("means_")


def embed(rows: DataFrame, name: str, embedder: Callable[[pd.Series], pd.Series], batch: int = 512) -> DataFrame:
    """rows -> name, embedding: the embedder's vectors of the normalised names, missing components imputed.

    The embedder takes a batch of names and returns as many lists of numbers. Each distinct name is embedded once.
    """
    from kindred.functions.normalize import normalize_for_embedding

    ship(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch):
                part = frame.iloc[first : first + batch]
                yield pd.DataFrame({"key_": part.key_, "embedding": [list(map(float, v)) for v in embedder(part.key_)]})

    keyed = rows.select(F.col(f"`{name}`")).withColumn("key_", normalize_for_embedding(F.col(f"`{name}`").cast("string")))
    vectors = keyed.where("key_ is not null").select("key_").distinct().mapInPandas(run, "key_ string, embedding array<double>")
    return keyed.join(impute_column_means(vectors, "embedding"), "key_", "left").select(f"`{name}`", "embedding")


def wide_embeddings(rows: DataFrame, name: str, dims: int) -> DataFrame:
    """name, embedding -> name, emb_001, emb_002, ...: one column for each place, as for a CSV file."""
    return rows.select(f"`{name}`", *[F.get("embedding", F.lit(i)).alias(f"emb_{i + 1:03d}") for i in range(dims)])


def embedding_summary(rows: DataFrame, vector: str) -> DataFrame:
    """n, dims, and the cumulative share (in %) of variance of the first 1, 2, 10 and 100 principal components of scaled columns."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation

    spark = rows.sparkSession
    vectors = rows.select(array_to_vector(F.col(f"`{vector}`").cast("array<double>")).alias("v")).where("v is not null")
    n = vectors.count()
    matrix = np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray())  # dims x dims
    parts = np.cumsum(np.sort(np.linalg.eigvalsh(matrix))[::-1])
    share = lambda k: round(float(parts[min(k, len(parts)) - 1] / parts[-1] * 100), 1)
    return spark.createDataFrame([(n, len(parts), share(1), share(2), share(10), share(100))], "n long, dims long, p1 double, p2 double, p10 double, p100 double")
