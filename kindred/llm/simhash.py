"""SimHash near-duplicates found by covering locality-sensitive hashing.

Pagh (2016): give each of the 64 bit positions a vector of r + 1 bits; for each of the 2^(r+1) - 1 non-zero vectors v, a
mask keeps the positions whose vector has an odd inner product with v. The at most r positions in which two
fingerprints differ span no more than r dimensions, so some v is orthogonal to all of them and that table's mask drops
every differing bit: the pair collides. No pair within the radius can be missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.shared import batch, cut, free_name, lean, local_stars, node_of, runs, small_batches, stored, texts

RADIUS = 3
#: Fingerprints compared at once. A larger bucket is dealt out as pairs of blocks of about this size.
BLOCK = 1024
SEED = 42


def masks(radius: int = RADIUS) -> list[int]:
    """One 64-bit mask (as a signed integer) for each non-zero vector of radius + 1 bits.

    The vectors of the positions go round the non-zero ones, so that each mask keeps about half of the bits.
    """
    n = (1 << radius + 1) - 1
    of = [1 + i % n for i in range(64)]
    out = [sum(1 << i for i in range(64) if (of[i] & v).bit_count() & 1) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def fingerprint(text: str, width: int = 3) -> int:
    """64 bits, each set if set in over half of the hashes (XXH64, seed 42) of the text's word shingles, repeats included.

    Words are what ASCII white space separates, A-Z lower-cased. A text of fewer words is one shingle; one without
    words has fingerprint 0.
    """
    import xxhash

    words = text.encode().lower().split()
    n, digest = len(words), xxhash.xxh64_digest
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        raw = digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[: n - width] + 1]).tolist()
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    total, shingles = np.zeros(64, np.int64), len(raw) // 8
    for first in range(0, len(raw), 8 * 4096):
        part = np.frombuffer(raw[first : first + 8 * 4096], np.uint8)
        total += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > shingles).tobytes(), "big")


def with_fingerprint(docs: DataFrame, key: str, text: str, width: int = 3) -> DataFrame:
    """docs -> key, fp (the fingerprint as a signed 64-bit integer). A null text counts as an empty one."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.mapInArrow(lean(_fingerprints(width)), f"key {kind}, fp long").withColumnRenamed("key", key)


def _fingerprints(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, int] = {}
            for x in texts(b.column(1)):
                if x not in seen:
                    seen[x] = fingerprint(x, width)
            fps = np.array([seen[x] for x in texts(b.column(1))], np.uint64).view(np.int64)
            yield batch({"key": (b.column(0), None), "fp": (fps, pa.int64())})

    return run


def bucket_blocks(rows: DataFrame, bucket: list[str], member: str, block: int = BLOCK, attach: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """rows (bucket..., member, ...) -> those in buckets of two or more, each once for every pair of blocks it is part of.

    A bucket of n rows has ceil(n / block) blocks, to which a hash of member deals its rows. Adds bi <= bj (the pair)
    and side (0: of block bi, 1: of bj). Partitioned and sorted by bucket and pair, so that one pair of blocks comes
    together. A large bucket spreads over many tasks of bounded size. attach may add columns to the rows that remain.
    """
    # the sizes are written apart, so that the join's two sides are plain shuffles and a large bucket can be split
    sizes = cut(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n_in")).where("n_in > 1"))
    many = rows.join(sizes, bucket).withColumn("n_in", F.ceil(F.col("n_in") / block).cast("int"))
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("n_in")).cast("int")
    dealt = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_in") - 1)))
    pairs = dealt.select(*rows.columns, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    return attach(pairs).repartition(*bucket, "bi", "bj").sortWithinPartitions(*bucket, "bi", "bj")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """fps (fp long, each once) -> (u, v): enough links within the radius to span every component, u > v.

    A bucket's members are compared as blocks; of each pair of blocks only a star per local component comes out, so
    a group of n near copies gives about n rows a table and not n^2.
    """
    table = F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("b")) for t, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(table).alias("x")).select("x.t", "x.b", "fp")
    return bucket_blocks(rows, ["t", "b"], "fp", block).mapInArrow(lean(_compare(radius)), "u long, v long").distinct()


def _compare(radius: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, ["t", "b", "bi", "bj"], 4096):
            every = table.column("fp").to_numpy()
            us, vs = [], []
            sizes = np.diff(bounds)
            pairs = bounds[:-1][sizes == 2]
            a, b = every[pairs], every[pairs + 1]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= radius
            us.append(np.maximum(a, b)[near])
            vs.append(np.minimum(a, b)[near])
            for g in np.flatnonzero(sizes != 2):
                fp = np.sort(every[bounds[g] : bounds[g + 1]])
                x = fp.view(np.uint64)
                linked = np.empty((len(x), len(x)), bool)
                for first in range(0, len(x), 256):
                    linked[first : first + 256] = np.bitwise_count(x[first : first + 256, None] ^ x[None, :]) <= radius
                root = local_stars(linked)
                own = root != np.arange(len(fp))
                us.append(fp[own])
                vs.append(fp[root[own]])
            yield batch({"u": (np.concatenate(us), pa.int64()), "v": (np.concatenate(vs), pa.int64())})

    return run


def near_duplicates(docs: DataFrame, key: str, text: str, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs -> key, fp, component: the smallest key that links of at most `radius` differing bits reach, own key included.

    One row per input row; equal fingerprints are one node, so groups of exact copies cost one row. A null text is an
    empty one; null keys are never the smallest unless a component has no other. An empty table gives no rows.
    """
    own = stored(with_fingerprint(docs, key, text, width).withColumnRenamed(key, "key"), "simhash")
    nodes = stored(own.groupBy("fp").agg(F.min("key").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(named.groupBy("root").agg(F.min("first").alias("component")))  # so that a large component can be split in the join
    labels = named.join(least, "root").select("fp", "component")
    return own.join(labels, "fp", "left").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str, text: str, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each group of near-duplicates: that with the smallest key stays.

    Rows of one key and the same words count as one document; a key that holds different texts keeps one of each group.
    Rows with a null key have no identity; they stay as they are.
    """
    row, node = free_name(docs, "row"), free_name(docs, "node")
    keyed = docs.where(F.col(f"`{key}`").isNotNull()).withColumn(node, node_of(F.col(f"`{text}`")))
    found = near_duplicates(keyed.withColumn(row, F.struct(F.col(f"`{key}`").alias("key"), F.col(node).alias("node"))), row, text, width, radius)
    keep = found.where(F.col(row) == F.col("component")).select(F.col("component.key").alias("chosen_key"), F.col("component.node").alias("chosen_node")).distinct()
    once = keyed.join(keep, (keyed[f"`{key}`"] == keep["chosen_key"]) & (keyed[node] == keep["chosen_node"]), "left_semi").dropDuplicates([key, node]).drop(node)
    return once.unionByName(docs.where(F.col(f"`{key}`").isNull()))
