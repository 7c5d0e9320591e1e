"""What the operators share: reading tables, the folder all executors see, Arrow batches and numpy helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.shipping import ship

ARROW_ROWS = 2048
ARROW_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Ready the session for Arrow functions: batches small enough for very long texts, and this package on the workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def lean(run: Callable) -> Callable:
    """An Arrow function whose worker gives freed memory back to the system when a task ends.

    Workers serve many tasks, and stay while the JVM works; what the allocators keep for later (100 MB and more) would
    count against the executor all that time.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    On one machine (a local master) a temporary folder serves where it is unset; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="kindred-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to a new path of the shared folder and read again: columnar, so later readers prune."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; forget() deletes what is there."""
    _scratch.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _scratch[-1]


def forget(spark: SparkSession) -> int:
    """Delete the tables that operators of this process wrote for themselves. DataFrames that read them end with this."""
    n = 0
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


_scratch: list[str] = []


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def key_names(names: list[str], results: tuple[str, ...]) -> list[str]:
    """What key columns are called beside results: their names, with a leading underscore for each clash."""
    out: list[str] = []
    for name in names:
        while name.lower() in {r.lower() for r in results} | {x.lower() for x in out}:
            name = f"_{name}"
        out.append(name)
    return out


def batch(columns: dict[str, tuple[list | np.ndarray | pa.Array, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns.values()], names=list(columns))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def node_of(text: Column) -> Column:
    """128 bits that texts of the same words in the same order share. A null text counts as an empty one."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.trim(F.regexp_replace(plain, r"[ \t\n\x0B\f\r]+", " "))))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys as tables of whole groups, of about `least` rows or more, and where each group begins (one more: the end)."""
    held: list[pa.RecordBatch] = []
    n = 0

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(change), [t.num_rows]])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= least:
            t = pa.Table.from_batches(held)
            at = edges(t)
            if at[-2]:  # the last group may go on
                yield t.slice(0, int(at[-2])), at[:-1]
                t = t.slice(int(at[-2]))
            held = t.to_batches()
            n = 0 if at[-2] else n
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, edges(t)


def local_stars(linked: np.ndarray) -> np.ndarray:
    """The component of each row of a symmetric boolean matrix, named by its smallest index."""
    n = len(linked)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        seen = linked[i].copy()
        seen[i] = True
        front = np.flatnonzero(seen)
        while len(front) > 1 or (len(front) == 1 and front[0] != i):
            new = linked[front].any(axis=0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
            if not len(front):
                break
        root[seen] = i
    return root
