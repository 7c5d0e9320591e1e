"""All pairs of two tables of vectors, computed as blocks of bounded size; only what is asked of them leaves a block.

Rows are packed once into blocks, which are kept in the checkpoint folder. Pairs of blocks are then dealt out as a Cartesian
product of partitions, which reads the blocks again in every task and shuffles nothing: what is shuffled and written follows
the rows, not their pairs. Products are looked through in single precision where that tells pairs at the threshold apart;
what lies within rounding of it is decided by sums of squares in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, LongType, StructField, StructType

from kindred.functions.shipping import ship

#: Vectors of a block, pairs looked at together, hits computed together, rows of a batch that a task returns.
BLOCK, TILE, HITS, OUT = 2048, 1 << 19, 1 << 15, 1 << 16
#: Blocks of a partition at most, and partitions wanted before one takes more than one block.
HELD, SPREAD = 8, 12


def block_pairs(left: DataFrame, right: DataFrame, carry: tuple[Column, Column], vector: tuple[Column, Column], same: bool, block: int = BLOCK) -> DataFrame:
    """Rows (l_at, l_carry, l_vectors, r_at, r_carry, r_vectors), one for each pair of blocks: what they carry as lists, vectors as bytes.

    same: both sides are one table and order doesn't matter; of (a, b) and (b, a) only one then comes. Null vectors take no part.
    """
    ship(left.sparkSession)
    x = packed(left, carry[0], vector[0], block)
    y = x if same else packed(right, carry[1], vector[1], block)
    x, y = (df.select([F.col(c).alias(f"{side}_{c}") for c in df.columns]) for df, side in ((x, "l"), (y, "r")))
    odd = lambda at: (F.shiftright(at, 33) + at) % 2
    a, b = F.col("l_at"), F.col("r_at")
    once = (a == b) | ((a < b) == (odd(a) != odd(b)))  # either order for half of the pairs, so that tasks have like shares
    return x.join(y.hint("shuffle_replicate_nl"), once if same else F.lit(True))


def packed(df: DataFrame, carry: Column, vector: Column, block: int = BLOCK) -> DataFrame:
    """at, carry, vectors: blocks of 1.25 * block rows at most, dealt over partitions of at most HELD or so, and kept."""
    rows = df.select(carry.alias("carry"), vector.alias("v")).where("v is not null")
    single = isinstance(getattr(rows.schema["v"].dataType, "elementType", None), FloatType)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{'float' if single else 'double'}>"))
    n = -(-rows.count() // block)
    parts = max(1, -(-n // min(HELD, max(1, n // SPREAD))))
    schema = StructType([StructField("carry", ArrayType(rows.schema["carry"].dataType)), StructField("single", LongType()), StructField("vectors", BinaryType())])
    out = rows.repartition(parts).mapInArrow(_pack(single, block), schema)
    return kept(out.withColumn("at", F.monotonically_increasing_id()))


def kept(df: DataFrame) -> DataFrame:
    """df held fast: in the checkpoint folder, or where none is set by the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def _pack(single: bool, block: int) -> Callable:
    def one(t: pa.Table) -> pa.RecordBatch:
        carry, v = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column("carry"), t.column("v")))
        if pc.min(pc.list_value_length(v)).as_py() != pc.max(pc.list_value_length(v)).as_py():
            raise ValueError("vectors of a column differ in length")
        numbers = v.flatten()
        numbers = numbers.fill_null(pa.scalar(float("nan"), numbers.type)) if numbers.null_count else numbers
        numbers = numbers.to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64, copy=False)
        lists = pa.ListArray.from_arrays(pa.array([0, len(carry)], pa.int32()), carry)
        return pa.RecordBatch.from_arrays([lists, pa.array([int(single)], pa.int64()), pa.array([numbers.tobytes()], pa.binary())], names=["carry", "single", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n > block + block // 4:
                t, at = pa.Table.from_batches(held), 0
                while n - at > block + block // 4:
                    yield one(t.slice(at, block))
                    at += block
                held, n = t.slice(at).to_batches(), n - at
        if n:
            yield one(pa.Table.from_batches(held))

    return run


def each_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """For each row of block_pairs: whether it is one block against itself, what both carry, their vectors."""
    for b in batches:
        col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
        for r in range(b.num_rows):
            carried = [col[f"{s}_carry"][r].values for s in "lr"]
            u, v = (np.frombuffer(col[f"{s}_vectors"][r].as_buffer(), np.float32 if col[f"{s}_single"][r].as_py() else np.float64) for s in "lr")
            u, v = u.reshape(len(carried[0]), len(u) // len(carried[0])), v.reshape(len(carried[1]), len(v) // len(carried[1]))
            if u.shape[1] != v.shape[1]:
                raise ValueError(f"vectors of {u.shape[1]} and {v.shape[1]} numbers have no distance")
            yield col["l_at"][r].as_py() == col["r_at"][r].as_py(), *carried, u, v


def joined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Many batches as few."""
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def symmetric(metric: str | Callable) -> bool:
    """Whether a distance is the same both ways: the named ones are; a function may say so by an attribute symmetric."""
    return isinstance(metric, str) or bool(getattr(metric, "symmetric", False))


def near(u: np.ndarray, v: np.ndarray, metric: str | Callable, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j and distances of the pairs of rows at most limit apart, a tile of pairs at a time."""
    if not len(u) or not len(v):
        return
    tile = max(1, TILE // len(v))
    if callable(metric):
        yield from _by_function(u.astype(float), v.astype(float), metric, limit, tile)
        return
    if metric not in ("euclidean", "rmse_eps"):
        raise ValueError(f"metric is euclidean, rmse_eps or a function, not {metric!r}")
    wide, rows = (u.astype(float), v.astype(float)), len(v)
    for places in _all(len(u), rows, tile) if np.isinf(limit) else _candidates(*wide, metric, limit, tile):
        for first in range(0, len(places), HITS):
            i, j = np.divmod(places[first : first + HITS], rows)
            apart = wide[0][i] - wide[1][j]
            gap = (apart * apart).sum(axis=1)
            d = np.sqrt(gap) if metric == "euclidean" else np.sqrt(gap / u.shape[1] + 1e-4)
            ok = d <= limit
            yield i[ok], j[ok], d[ok]


def _all(n: int, rows: int, tile: int) -> Iterator[np.ndarray]:
    for first in range(0, n, tile):
        yield np.arange(first * rows, min(n, first + tile) * rows)


def _candidates(u: np.ndarray, v: np.ndarray, metric: str, limit: float, tile: int) -> Iterator[np.ndarray]:
    """Places i * rows of v + j of all pairs at most limit apart, and of some beyond it by rounding alone."""
    most = -1.0 if limit < 0 else limit * limit if metric == "euclidean" else (limit * limit - 1e-4) * u.shape[1] + 1e-12 * (limit * limit + 1) * u.shape[1]
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    sizes = np.concatenate([uu[np.isfinite(uu)], vv[np.isfinite(vv)], [0.0]])
    scale = 4 * sizes.max() + abs(most)  # of anything summed up on the way
    slack = lambda t: (u.shape[1] + 16) * float(np.finfo(t).eps) * scale
    t = np.float32 if scale < 1e30 and slack(np.float32) <= 1e-3 * most else np.float64
    one = lambda n: np.ones((n, 1))
    with np.errstate(invalid="ignore", over="ignore"):
        a = np.hstack([-2 * u, (uu - most - slack(t))[:, None], one(len(u))]).astype(t)
        b = np.hstack([v, one(len(v)), vv[:, None]]).astype(t).T
        for first in range(0, len(u), tile):
            yield np.flatnonzero(a[first : first + tile] @ b <= 0) + first * len(v)


def _by_function(u: np.ndarray, v: np.ndarray, metric: Callable, limit: float, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The function's own distances: of all pairs, or where it has an attribute at_least, of those whose lower bound is within the limit."""
    at_least = getattr(metric, "at_least", None) if limit < np.inf else None
    for first in range(0, len(u), tile):
        part = u[first : first + tile]
        if at_least is None:
            d = np.stack([np.asarray(metric(x, v), dtype=float) for x in part])
            i, j = np.nonzero(d <= limit)
            yield i + first, j, d[i, j]
            continue
        i, j = np.nonzero(~(at_least(part, v) > limit))
        edges = np.searchsorted(i, np.arange(len(part) + 1))
        rows = [k for k in range(len(part)) if edges[k] < edges[k + 1]]
        if rows:
            d = np.concatenate([np.asarray(metric(part[k], v[j[edges[k] : edges[k + 1]]]), dtype=float) for k in rows])
            ok = d <= limit
            yield i[ok] + first, j[ok], d[ok]


def manhattan_at_least(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Lower bounds of the sums of absolute differences of all pairs of rows, for a function's attribute at_least.

    Components are rounded to whole steps, so few that sums fit 16 bits; |x - y| = 2 max(x, y) - x - y of these, less what
    the rounding of both rows can have added, is no more than the distance. -inf where a number isn't finite.
    """
    dims = u.shape[1]
    levels = 65535 // max(dims, 1)
    whole = [np.isfinite(w).all(axis=1) for w in (u, v)]
    flat = np.concatenate([w[k].ravel() for w, k in zip((u, v), whole, strict=True)] + [np.zeros(0)])
    low, high = (flat.min(), flat.max()) if flat.size else (0.0, 0.0)
    step = (high - low) / levels if levels else 0.0
    if not 0 < step < np.inf:
        return np.full((len(u), len(v)), -np.inf)
    x, y = (np.where(k[:, None], w, low) for w, k in zip((u, v), whole, strict=True))
    p, q = (np.clip(np.rint((w - low) / step), 0, levels).astype(np.uint16) for w in (x, y))
    # what a row's rounding can add, and its steps
    lost = [np.where(k, np.abs(w - (low + n * step)).sum(axis=1), np.inf) for w, n, k in zip((x, y), (p, q), whole, strict=True)]
    base = q.sum(axis=1, dtype=np.int64) * step + lost[1] + 1e-12 * (abs(low) + abs(high)) * dims
    own = p.sum(axis=1, dtype=np.int64) * step + lost[0]
    columns, tops, out = np.ascontiguousarray(q.T), np.empty(len(v), np.uint16), np.empty((len(u), len(v)))
    larger = np.empty_like(columns)
    for k in range(len(p)):
        np.maximum(columns, p[k][:, None], out=larger)
        np.add.reduce(larger, axis=0, dtype=np.uint16, out=tops)
        np.multiply(tops, 2 * step, out=out[k])
        out[k] -= base
        out[k] -= own[k]
    return out
