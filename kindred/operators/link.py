"""Linking two tables of organisations by name: directly, by embeddings, or through an alias directory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from kindred.functions.distance import NAME_DISTANCES
from kindred.functions.normalize import NormalizeOptions, normalize_name
from kindred.functions.progress import progress
from kindred.operators import calibrate
from kindred.operators.matching import name_pairs, smaller, vector_pairs
from kindred.sources.files import clean_directory

TARGET, TARGET_NETWORK = 10.0, 2.0
ALGORITHMS = ("fuzzy", "embedding", "network")
_LX, _LY = "left_name_", "right_name_"


@dataclass
class LinkParts:
    """links: the result. raw: pairs found directly, network: through the directory (None without one), both by raw names."""

    links: DataFrame
    raw: DataFrame
    network: DataFrame | None


def link(
    left: DataFrame, right: DataFrame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, *, algorithm: str = "fuzzy",
    max_dist: float | None = None, target_matches: float | None = None, distance: str = "jaccard", q: int = 2, normalize: NormalizeOptions = NormalizeOptions(),
    directory: DataFrame | None = None, max_dist_network: float | None = None, target_matches_network: float | None = None, network_weight: float = 1.5,
    left_embedding: str | None = None, right_embedding: str | None = None, metric: str | Callable = "euclidean",
    embedder: Callable | None = None, how: str = "inner", diagnostics: bool = False, return_parts: bool = False, seed: int = 0,
) -> DataFrame | LinkParts:
    """The approximate join of left and right on one column of names each.

    One row for each pair of raw names that match, with the columns of the first row of either name (the least by all its
    columns); columns that both tables have get _x and _y. stringdist is the direct distance, null for pairs found through
    the directory only; for the network algorithm stringdist_x2network, stringdist_y2network and canonical_id tell the
    best hop. minDist is the smaller of the direct distance and network_weight times the larger of the hop's two.

    Give max_dist or target_matches (the average number of matches for a name; 10 if neither is given), not both; for the
    directory likewise (2). how: inner, left, right or full; the last three keep names without a match too, one row for each. Null names
    match nothing and are not kept.
    """
    left_on, right_on = left_on or on, right_on or on
    _validate(left, right, left_on, right_on, algorithm, distance, max_dist, target_matches, max_dist_network, target_matches_network, directory, how)
    if embedder is not None and algorithm != "fuzzy":
        left, right, left_embedding, right_embedding = _embedded(left, right, left_on, right_on, embedder)
    by_vector = left_embedding is not None and right_embedding is not None
    if algorithm == "embedding" and not by_vector:
        raise ValueError("the embedding algorithm needs left_embedding and right_embedding, or an embedder")
    x, y = (_named(df, c, e if by_vector else None, normalize) for df, c, e in ((left, left_on, left_embedding), (right, right_on, right_embedding)))
    progress("matching names")
    raw = _match(x, y, distance, q, metric, by_vector, max_dist, TARGET if target_matches is None else target_matches, seed)
    raw = raw.withColumnRenamed("d", "stringdist")
    network = None
    if algorithm == "network":
        progress("matching both sides with the directory")
        network = _through(x, y, clean_directory(directory, normalize), distance, q, metric, by_vector and "embedding" in directory.columns, max_dist_network, TARGET_NETWORK if target_matches_network is None else target_matches_network, network_weight, seed)
    pairs = raw.withColumn("minDist", F.col("stringdist"))
    if network is not None:
        both = raw.join(network, [_LX, _LY], "full_outer")
        pairs = both.withColumn("minDist", F.least("stringdist", "net_")).drop("net_")
    out = _gather(left, right, left_on, right_on, pairs, how, diagnostics)
    return LinkParts(out, raw, network.drop("net_") if network is not None else None) if return_parts else out


def _validate(left, right, left_on, right_on, algorithm, distance, max_dist, target, max_dist_network, target_network, directory, how) -> None:
    for df, c, side in ((left, left_on, "left"), (right, right_on, "right")):
        if not isinstance(df, DataFrame):
            raise TypeError(f"{side} must be a DataFrame")
        if c is None or c not in df.columns:
            raise ValueError(f"{side} has no column {c!r}; give on, or left_on and right_on")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm is one of {', '.join(ALGORITHMS)}, not {algorithm!r}")
    if distance not in NAME_DISTANCES:
        raise ValueError(f"distance is one of {', '.join(sorted(NAME_DISTANCES))}, not {distance!r}")
    if max_dist is not None and target is not None or max_dist_network is not None and target_network is not None:
        raise ValueError("give a distance or a target number of matches, not both")
    if algorithm == "network" and directory is None:
        raise ValueError("the network algorithm needs a directory of alias_name and canonical_id")
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"how is inner, left, right or full, not {how!r}")


def _named(df: DataFrame, name: str, vector: str | None, normalize: NormalizeOptions) -> DataFrame:
    """One row for every row: raw, name (normalised) and perhaps v."""
    raw = F.col(f"`{name}`").cast("string")
    cols = [raw.alias("raw"), normalize_name(raw, normalize).alias("name")]
    return df.select(*cols, *([F.col(f"`{vector}`").alias("v")] if vector else []))


def _embedded(left, right, left_on, right_on, embedder):
    from kindred.operators.matching import embed

    def add(df: DataFrame, name: str) -> DataFrame:
        vectors = embed(df.select(f"`{name}`").where(F.col(f"`{name}`").isNotNull()).distinct(), name, embedder)
        return df.join(vectors.withColumnsRenamed({name: "name_", "embedding": "embedding_"}), F.col(f"`{name}`") == F.col("name_"), "left").drop("name_")

    return add(left, left_on), add(right, right_on), "embedding_", "embedding_"


def _match(x: DataFrame, y: DataFrame, distance, q, metric, by_vector, max_dist, target, seed) -> DataFrame:
    """x, y (raw, name, v) -> left_name_, right_name_ (raw names), d. A pair of names has its smallest distance."""
    if by_vector:
        if max_dist is None:
            max_dist = calibrate.vector_threshold(x, y, "v", "v", target, metric, seed)
        x, y = (df.where("raw is not null").groupBy("raw").agg(F.collect_set("v").alias("vs")).select("raw", F.explode("vs").alias("v")).withColumn("i", _vector_id()) for df in (x, y))
        found = vector_pairs(x, y, "i", "i", "v", "v", max_dist, metric)
        named = found.join(x.select(F.col("raw").alias(_LX), F.col("i").alias("left_id")), "left_id").join(y.select(F.col("raw").alias(_LY), F.col("i").alias("right_id")), "right_id")
        return named.groupBy(_LX, _LY).agg(F.min("stringdist").alias("d"))
    if max_dist is None:
        max_dist = calibrate.name_threshold(x, y, "name", "name", target, distance, q, seed)
    found = name_pairs(x, y, "name", "name", distance, q, probe=smaller(x, y), max_dist=max_dist)
    xs, ys = (df.where("raw is not null").select("raw", "name").distinct() for df in (x, y))
    named = found.join(xs.select(F.col("raw").alias(_LX), F.col("name").alias("left_name")), "left_name").join(ys.select(F.col("raw").alias(_LY), F.col("name").alias("right_name")), "right_name")
    return named.select(_LX, _LY, F.col("stringdist").alias("d"))


def _vector_id() -> Column:
    """A name and its vector as 256 bits."""
    return F.sha2(F.concat_ws(":", F.sha2(F.col("raw").cast("binary"), 256), F.array_join(F.transform(F.col("v").cast("array<double>"), lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")).cast("binary"), 256)


def resolve(names: DataFrame, directory: DataFrame, distance: str = "jaccard", q: int = 2, max_dist: float | None = None, target: float = TARGET_NETWORK, seed: int = 0, metric: str | Callable = "euclidean", by_vector: bool = False) -> DataFrame:
    """names (raw, name, v), directory (alias_name, canonical_id) -> raw, canonical_id, d: the least distance to any alias."""
    aliases = directory.select(F.col("alias_name").alias("raw"), F.col("alias_name").alias("name"), *([F.col("embedding").alias("v")] if by_vector else []))
    found = _match(names, aliases, distance, q, metric, by_vector, max_dist, target, seed)
    own = directory.select(F.col("alias_name").alias(_LY), "canonical_id")
    return found.join(own, _LY).groupBy(F.col(_LX).alias("raw"), "canonical_id").agg(F.min("d").alias("d"))


def _through(x, y, directory, distance, q, metric, by_vector, max_dist, target, weight, seed) -> DataFrame:
    to = lambda names: resolve(names, directory, distance, q, max_dist, target, seed, metric, by_vector)
    dx = to(x).select(F.col("raw").alias(_LX), "canonical_id", F.col("d").alias("stringdist_x2network"))
    dy = to(y).select(F.col("raw").alias(_LY), "canonical_id", F.col("d").alias("stringdist_y2network"))
    hop = dx.join(dy, "canonical_id").withColumn("net_", F.lit(float(weight)) * F.greatest("stringdist_x2network", "stringdist_y2network"))
    best = F.min_by(F.struct("stringdist_x2network", "stringdist_y2network", "canonical_id", "net_"), F.struct("net_", "canonical_id")).alias("best")
    return hop.groupBy(_LX, _LY).agg(best).select(_LX, _LY, "best.*")


def _gather(left: DataFrame, right: DataFrame, left_on: str, right_on: str, pairs: DataFrame, how: str, diagnostics: bool) -> DataFrame:
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    shown = lambda c, s: f"{c}{s}" if c.lower() in both else c

    def first(df: DataFrame, name: str, suffix: str, key: str, kept: list[str]) -> DataFrame:
        row = F.min_by(_row(df, kept), _row(df, [c for c in kept if not isinstance(df.schema[c].dataType, (MapType, VariantType))]))
        picked = df.where(F.col(f"`{name}`").isNotNull()).groupBy(F.col(f"`{name}`").cast("string").alias(key)).agg(row.alias("row_"))
        return picked.select(key, *[F.col(f"row_.c{df.columns.index(c)}").alias(shown(c, suffix)) for c in kept])

    keep_x = [c for c in left.columns if c != "embedding_"]
    keep_y = [c for c in right.columns if c != "embedding_"]
    fx, fy = first(left, left_on, "_x", _LX, keep_x), first(right, right_on, "_y", _LY, keep_y)
    kinds = {"inner": ("inner", "inner"), "left": ("right", "left"), "right": ("inner", "right"), "full": ("right", "full_outer")}[how]
    out = pairs.join(fx, _LX, kinds[0]).join(fy, _LY, kinds[1])
    extra = [c for c in pairs.columns if c not in (_LX, _LY)]
    cols = [*[shown(c, "_x") for c in keep_x], *[shown(c, "_y") for c in keep_y], *extra]
    if diagnostics:
        from kindred.functions.normalize import value_id

        ids = ["left_value_id", "right_value_id", "pair_id"]
        out = out.withColumns({ids[0]: value_id(F.col(_LX)), ids[1]: value_id(F.col(_LY))}).withColumn(ids[2], F.sha2(F.concat_ws(":", *ids[:2]), 256))
        cols += ids
    return out.select(*[f"`{c}`" for c in cols])


def _row(df: DataFrame, columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"c{df.columns.index(c)}") for c in columns])


def lookup(names: DataFrame, name: str, directory: DataFrame, normalize: NormalizeOptions = NormalizeOptions()) -> DataFrame:
    """names with the canonical_id of the alias that equals their normalised name; names without one are left out."""
    own = clean_directory(directory, normalize).select(F.col("alias_name").alias("alias_"), "canonical_id")
    keyed = names.withColumn("key_", normalize_name(F.col(f"`{name}`").cast("string"), normalize))
    return keyed.join(own, F.col("key_") == F.col("alias_")).drop("key_", "alias_")


def top_matches(pairs: DataFrame, k: int, name: str = "left_name", other: str = "right_name", distance: str = "stringdist") -> DataFrame:
    """The k nearest of each name, ties by the other name."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(name).orderBy(distance, other))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
