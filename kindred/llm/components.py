"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014).

Every round is made of equi-joins and aggregates with partial sums; only a count and a checksum of a round's links
come to the driver. Each round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links (u, v) -> (node, root), one row per node that has a link to a smaller one; root is the smallest node reachable.

    Nodes without links, and the roots themselves, are not in the result. Links of a node to itself and rows with a
    null count for nothing; repeated links count once. An empty table gives an empty result.
    """
    a, b = F.greatest("u", "v"), F.least("u", "v")
    edges = cut(links.where("u is not null and v is not null and u <> v").select(a.alias("u"), b.alias("v")).distinct())
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written apart, so that the join's two sides are plain shuffles and a node with very many links can be split
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))  # written apart, as above
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
