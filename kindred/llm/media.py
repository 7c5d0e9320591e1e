"""Media payloads in a store of content-defined chunks.

A rolling gear hash cuts every payload where its last bytes say so, so that equal passages give equal chunks wherever
they stand. Chunk digests meet in Spark joins: a digest that occurs once stays with its payload, in that payload's pack; one
that occurs more often is stored once, in a shared table. A payload's ordered chunk list says how to put it together again.

Most bytes never move: a Bloom filter of the digests that occur more often (of fixed size, so what it lets through
by mistake grows with the input, never its memory) tells the writers which chunks may be shared; only those are dealt
out by digest. Packs that hold all of their chunks are read back where they lie.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.shared import batch, lean, runs, scratch, small_batches, stored, texts

#: Payloads are padded with PAD to a positive multiple of UNIT bytes.
UNIT, PAD = 576, b"\xff"
#: Least and largest chunk, and bits of the hash that are zero at a cut (one place in 2^CUT_BITS).
LEAST, MOST, CUT_BITS = 512, 8192, 11
#: Bits of the Bloom filter and places of a digest in it.
FILTER_BITS, PLACES = 1 << 26, 3
LEVEL = 6
RATE = 8000
_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)
PACK = "media binary, digests array<binary>, sizes array<int>, own array<boolean>, blob binary"


def payload(text: str) -> tuple[bytes, int]:
    """A text's padded payload and its own length in bytes."""
    raw = text.encode()
    return raw + PAD * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw)), len(raw)


def wave(samples: bytes) -> bytes:
    """A WAVE file of one channel of 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(file: bytes) -> bytes:
    """The samples of such a file."""
    n = struct.unpack("<I", file[40:44])[0]
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or n != len(file) - 44:
        raise ValueError("not a WAVE file of this store")
    return file[44:]


def cuts(data: bytes) -> list[int]:
    """Where the chunks of data end. Depends on the bytes alone; each cut on the 32 bytes before it."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for m in (1, 2, 4, 8, 16):  # the gear hash of the last 2m bytes from those of m: h(i) + (h(i - m) << m)
        h[m:] = h[m:] + (h[:-m] << np.uint32(m))
    at = np.flatnonzero(h[31:] >> np.uint32(32 - CUT_BITS) == 0) + 32
    out, last = [], 0
    while n - last > LEAST:
        k = np.searchsorted(at, last + LEAST)
        end = int(at[k]) if k < len(at) and at[k] <= last + MOST else min(last + MOST, n)
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Mean, root mean square about the middle, and crossings of the middle, of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"mean={x.sum() / len(x):.4f};rms={float((x * x).sum() / len(x)) ** 0.5:.4f};crossings={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())}"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text in texts(b.column(1)):
            data, n = payload(text)
            file = wave(data)
            rows.append((n, digest(file), [digest(c) for c in chunks(file)]))
        n, media, digests = zip(*rows, strict=True) if rows else ((), (), ())
        yield batch({"key": (b.column(0), None), "n_bytes": (list(n), pa.int64()), "media": (list(media), pa.binary()), "digests": (list(digests), pa.list_(pa.binary()))})


def _places(digests: np.ndarray) -> np.ndarray:
    """Bits of the filter for digests (n x 16 bytes)."""
    words = digests.view("<u4").reshape(len(digests), 4)
    return words[:, :PLACES].astype(np.int64) % FILTER_BITS


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's digests as words of the filter."""
    own: dict[int, int] = {}
    for b in batches:
        raw = b"".join(b.column(0).to_pylist())
        for p in np.unique(_places(np.frombuffer(raw, np.uint8).reshape(-1, 16))).tolist() if raw else []:
            own[p >> 5] = own.get(p >> 5, 0) | 1 << (p & 31)
    items = sorted(own.items())
    yield batch({"word": ([k for k, _ in items], pa.int32()), "bits": ([v for _, v in items], pa.int64())})


def _filter(repeated: DataFrame) -> np.ndarray:
    """The Bloom filter of a column of digests: FILTER_BITS / 8 bytes, whatever the input."""
    got = repeated.mapInArrow(lean(_bits), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def _write(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bits: np.ndarray = shared.value
        pack = zstandard.ZstdCompressor(level=LEVEL)
        sent: set[bytes] = set()
        for b in batches:
            out: list[tuple] = []
            size = 0
            for text in texts(b.column(0)):
                file = wave(payload(text)[0])
                parts = chunks(file)
                digests = [digest(c) for c in parts]
                places = _places(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16))
                many = ((bits[places >> 5] >> (places & 31).astype(np.uint32)) & 1).all(axis=1).tolist()
                own = [not m for m in many]
                blob = pack.compress(b"".join(c for c, o in zip(parts, own, strict=True) if o)) if any(own) else b""
                out.append((0, digest(file), digests, [len(c) for c in parts], own, blob))
                size += len(blob) + 64
                for c, d, m in zip(parts, digests, many, strict=True):
                    if m and d not in sent:  # once for a task
                        sent.add(d)
                        out.append((1, None, [d], [len(c)], [], pack.compress(c)))
                        size += len(out[-1][-1])
                if size > 4 << 20:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary())
    return batch({n: (list(c), t) for n, c, t in zip(("kind", "media", "digests", "sizes", "own", "blob"), zip(*rows, strict=True), kinds, strict=True)})


class Store:
    """packs: PACK, one row per stored payload (repeated payloads: rows without chunks of their own). shared: digest, blob.
    catalog: key, n_bytes, media (a digest of the file)."""

    def __init__(self, catalog: DataFrame, packs: DataFrame, shared: DataFrame):
        self.catalog, self.packs, self.shared = catalog, packs, shared


def write(docs: DataFrame, key: str, text: str) -> Store:
    """Store the payload of every text as a file of samples, in chunks. A null text is an empty one; null and repeated keys are rows of their own."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    listed = stored(own.mapInArrow(lean(_describe), f"key {kind}, n_bytes long, media binary, digests array<binary>"), "media-catalog")
    repeated = stored(listed.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "media-repeated")
    bits = spark.sparkContext.broadcast(_filter(repeated))
    base = scratch(spark, "media-store")
    own.select("text").mapInArrow(lean(_write(bits)), f"kind int, {PACK}").write.partitionBy("kind").parquet(f"{base}/written")
    written = spark.read.schema(f"{PACK}, kind int").parquet(f"{base}/written")
    sent = written.where("kind = 1").select(F.element_at("digests", 1).alias("digest"), "blob")
    # of the copies that tasks sent of a chunk, one stays; the others are never referred to
    kept = sent.withColumn("crc", F.crc32("blob")).groupBy("digest").agg(F.min_by("blob", "crc").alias("blob"))
    kept.write.parquet(f"{base}/shared")
    return Store(listed.select("key", "n_bytes", "media"), written.where("kind = 0").drop("kind"), spark.read.schema("digest binary, blob binary").parquet(f"{base}/shared"))


RESULT = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_chunks long, feature string"


def _result(media: bytes, parts: list[bytes]) -> tuple:
    file = b"".join(parts)
    if digest(file) != media:
        raise ValueError("a file read back differs from the one that was stored")
    samples = samples_of(file)
    return media, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(file), hashlib.sha256(file).hexdigest(), len(parts), features(samples)


def _result_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_chunks", "feature")
    kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
    return batch({n: (list(c), t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})


def _own_parts(blob: bytes, sizes: list[int], own: list[bool], unpack) -> dict[int, bytes]:
    raw = unpack.decompress(blob, max_output_size=sum(s for s, o in zip(sizes, own, strict=True) if o)) if blob else b""
    out, at = {}, 0
    for i, (s, o) in enumerate(zip(sizes, own, strict=True)):
        if o:
            out[i] = raw[at : at + s]
            at += s
    return out


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows = [_result(m, list(_own_parts(blob, sizes, own, unpack).values())) for m, _, sizes, own, blob in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield _result_rows(rows)


def _read_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for t, bounds in runs(batches, ["media"], 64):
        place, blobs = t.column("place").to_pylist(), t.column("blob").to_pylist()
        media, digests, sizes, own = (t.column(c) for c in ("media", "digests", "sizes", "own"))
        rows = []
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if place[a] != -1:
                raise ValueError("a payload has chunks but no list of them")
            listed, size = digests[a].as_py(), sizes[a].as_py()
            parts = _own_parts(blobs[a], size, own[a].as_py(), unpack)
            for i in range(a + 1, z):
                parts[place[i]] = unpack.decompress(blobs[i], max_output_size=size[place[i]])
            ordered = [parts[i] for i in range(len(listed))]
            if [digest(c) for c in ordered] != listed:
                raise ValueError("a chunk differs from its digest")
            rows.append(_result(media[a].as_py(), ordered))
            if len(rows) >= 64:
                yield _result_rows(rows)
                rows = []
        if rows:
            yield _result_rows(rows)


def read(store: Store) -> DataFrame:
    """Every stored file put together again, once: RESULT. Raises where bytes differ from their digests."""
    small_batches(store.packs.sparkSession)
    whole = F.forall("own", lambda o: o)
    here = store.packs.where(whole).mapInArrow(lean(_read_whole), RESULT)
    apart = store.packs.where(~whole).dropDuplicates(["media"])
    asked = apart.select("media", F.posexplode("own").alias("place", "has"), "digests").where("not has").select("media", "place", F.element_at("digests", F.col("place") + 1).alias("digest"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("digests", "array<binary>"), ("sizes", "array<int>"), ("own", "array<boolean>"))]
    fetched = asked.join(store.shared, "digest").select("media", "place", *none, "blob")
    rows = apart.select("media", F.lit(-1).alias("place"), "digests", "sizes", "own", "blob").unionByName(fetched)
    return here.unionByName(rows.repartition("media").sortWithinPartitions("media", "place").mapInArrow(lean(_read_joined), RESULT))


def round_trip(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Write docs' payloads and read them back: key, n_bytes and the columns of RESULT; one row per input row.

    Equal texts have equal values, whatever rows stand beside them. An empty table gives no rows.
    """
    store = write(docs, key, text)
    back = read(store)
    return store.catalog.join(back.withColumnRenamed("media", "media2"), F.col("media") == F.col("media2"), "left").drop("media2").withColumnRenamed("key", key)


def export(spark: SparkSession, store: Store, path: str) -> None:
    """What the store holds, as Parquet under path: catalog, packs, shared."""
    for name in ("catalog", "packs", "shared"):
        getattr(store, name).write.parquet(f"{path}/{name}")
