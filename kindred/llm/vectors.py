"""Near-duplicate vectors: randomly rotated binary codes with correction factors decide which pairs are computed exactly.

After a random rotation, a unit vector o keeps the signs of its components as a code x (of entries +-1/sqrt(D)) and one
number, f = <x, o>. For another vector q, <x, q> / f estimates <o, q> without bias, and lies within
e * sqrt((1 - f^2) / f^2 / (D - 1)) of it but for a chance that falls exponentially with e^2 (Gao and Long, 2024). Pairs
whose upper bound is below the threshold are dropped; all others are computed in double precision.

Which pairs meet at all is decided by sign codes too: vectors that agree in all bits of some table. Tables are so many
that a pair at the threshold is missed with a chance of MISS.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.shared import batch, cut, lean, runs, small_batches, stored
from kindred.llm.simhash import bucket_blocks

#: Width of the confidence bounds, chance of missing a pair at the threshold, vectors compared at once, pairs at once.
BOUND, MISS = 4.0, 1e-6
BLOCK, PAIRS = 512, 1 << 15
_SCALE = float(1 << 20)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def shape(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table and number of tables for n vectors."""
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2)))))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - min(agree**bits, 1 - 1e-9))))


def keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each vector in each table. Whole-number arithmetic: exact, so that every task finds the same."""
    dim = unit.shape[1]
    planes = np.hstack([rotation(dim, 100 + i) for i in range(-(-bits * tables // dim))])[:, : bits * tables]
    side = np.rint(unit * _SCALE) @ np.rint(planes * _SCALE) >= 0
    return side.reshape(len(unit), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _keys(bits: int, tables: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            labels, dims, vec = b.column(1), b.column(2).to_numpy(), b.column(3)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                k = keys(units(_matrix(vec.take(pa.array(at)))), bits, tables)
                n = len(at)
                each = np.repeat(at, tables)
                yield batch({"node": (b.column(0).to_numpy()[each], pa.int64()), "label": (labels.take(pa.array(each)), None), "dim": (dims[each], pa.int32()), "t": (np.tile(np.arange(tables), n), pa.int32()), "b": (k.ravel(), pa.int64())})

    return run


def _candidates(unit: np.ndarray, code: np.ndarray, f: np.ndarray, bounds: np.ndarray, side: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), within the groups that bounds delimit, that the codes' upper bounds don't rule out.

    apart: of a group, pairs across its sides are meant; else all.
    """
    dim = unit.shape[1]
    margin = BOUND * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / max(dim - 1, 1))
    left, right = [], []
    sizes = np.diff(bounds)
    small = np.flatnonzero(sizes <= 24)
    for s in np.unique(sizes[small]):
        i, j = np.triu_indices(s, 1)
        base = bounds[:-1][small[sizes[small] == s]]
        left.append((base[:, None] + i).ravel())
        right.append((base[:, None] + j).ravel())
    found = []
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        for first in range(0, len(a), PAIRS):
            x, y = a[first : first + PAIRS], b[first : first + PAIRS]
            up = np.minimum(np.einsum("ij,ij->i", unit[x], code[y]) / f[y] + margin[y], np.einsum("ij,ij->i", unit[y], code[x]) / f[x] + margin[x])
            ok = up >= threshold
            found.append((x[ok], y[ok]))
    for g in np.flatnonzero(sizes > 24):
        lo, hi = bounds[g], bounds[g + 1]
        up = unit[lo:hi] @ code[lo:hi].T / f[lo:hi] + margin[lo:hi]
        i, j = np.nonzero(np.triu(np.minimum(up, up.T) >= threshold, 1))
        found.append((lo + i, lo + j))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = ~apart[a] | (side[a] != side[b])
    return a[ok], b[ok]


def _compare(bits: int, tables: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs(batches, ["label", "dim", "t", "b", "bi", "bj"], 4096):
            node, mass, side, table, dims = (t.column(c).to_numpy() for c in ("node", "mass", "side", "t", "dim"))
            apart = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            vec = t.column("vec").combine_chunks()
            count, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)  # dim is a key: whole groups
                own = np.searchsorted(at, bounds)
                unit = units(_matrix(vec.take(pa.array(at))))
                turned = unit @ rotation(d, 1)
                code = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(d)
                f = (turned * code).sum(axis=1)
                a, b = _candidates(turned, code, f, np.unique(own), side[at], apart[at], threshold)
                k, kept = None, []
                for first in range(0, len(a), PAIRS):
                    x, y = a[first : first + PAIRS], b[first : first + PAIRS]
                    ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    kept.append((x[ok], y[ok]))
                    if ok.any():
                        k = keys(unit, bits, tables) if k is None else k
                        x, y = x[ok], y[ok]
                        # a pair counts in the first table in which it meets
                        new = (k[x] == k[y]).argmax(axis=1) == table[at[x]]
                        np.add.at(count, at[x[new]], mass[at[y[new]]])
                        np.add.at(count, at[y[new]], mass[at[x[new]]])
                if kept:
                    x, y = (at[np.concatenate(z)] for z in zip(*kept, strict=True))
                    while len(x):
                        before = root.copy()
                        np.minimum.at(root, x, root[y])
                        np.minimum.at(root, y, root[x])
                        root = root[root]
                        if (root == before).all():
                            break
            has = (count > 0) | (root != np.arange(len(node)))
            if has.any():
                yield batch({"node": (node[has], pa.int64()), "n": (count[has], pa.int64()), "root": (node[root[has]], pa.int64())})

    return run


def valid(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    big = F.lit(float("inf"))
    return F.coalesce(F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False))) & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, key: str, vector: str, label: str, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """rows -> key, n_links, component, kept; one row per input row.

    n_links: other rows of the same label at a cosine of at least threshold. component: the smallest key that links
    reach, the row's own included. kept: whether that is the row's own. Vectors of different lengths, rows with a null label,
    and vectors that are null, zero or have null or non-finite components link with nothing. Equal vectors are one
    node with a mass, so copies cost no pairs; a vector's near copies are compared in blocks, and come out as counts and one
    star per block. Null keys are never the smallest unless a component has no other. An empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vec"))
    ok = F.col("label").isNotNull() & valid(F.col("vec"))
    same = own.where(ok).groupBy("label", "vec").agg(F.count(F.lit(1)).alias("mass"), F.min("key").alias("first"))
    nodes = cut(same.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    bits, tables = shape(nodes.count(), threshold)
    met = nodes.select("node", "label", "dim", "vec").mapInArrow(lean(_keys(bits, tables)), f"node long, label {nodes.schema['label'].dataType.simpleString()}, dim int, t int, b long")
    attach = lambda df: df.join(nodes.select("node", "mass", "vec"), "node")
    found = bucket_blocks(met, ["label", "dim", "t", "b"], "node", block, attach).mapInArrow(lean(_compare(bits, tables, threshold)), "node long, n long, root long")
    found = stored(found, "vector-links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut(named.groupBy("root").agg(F.min("first").alias("component")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    done = named.join(least, "root").join(counts, "node", "left").select(F.col("label").alias("label2"), F.col("vec").alias("vec2"), (F.coalesce("n", F.lit(0)) + F.col("mass") - 1).alias("n_links"), "component")
    linked = own.where(ok).join(done, (F.col("label") == F.col("label2")) & (F.col("vec") == F.col("vec2")), "left").select("key", "n_links", "component")
    alone = own.where(~ok).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component", F.col("key").eqNullSafe(F.col("component")).alias("kept"))
