"""WARC archives of individually compressed records with a Zstandard dictionary in a leading skippable frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on its own records; every
record then is one Zstandard frame compressed with it, so each can be read alone. Of records with equal payloads one is a
response, and the others are revisits without payload. Archives are rows of a Parquet table, each the bytes of one
.warc.zst file, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import batch, cut, lean, small_batches, stored

#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 1000
#: Uncompressed bytes after which an archive ends, size of a dictionary, and bytes of records it is trained on at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 8 << 20, 64 << 10, 4 << 20
LEVEL = 6
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "archive_id string, n_records long, dictionary_bytes long, content binary"


def with_types(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """pages -> key, url, payload (bytes), digest, record_type, refers_to.

    Payloads of `least` bytes or more are grouped by SHA-1, in narrow rows of key and digest. The largest key of a group
    is the response. Payloads then meet what is said of their own key and digest, so those of a common page are dealt
    out by their keys and never gather in one task. Smaller payloads do not move.
    """
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= least
    narrow = stored(rows.where(large).select("key", "digest"), "warc-keys")
    same = narrow.groupBy("digest").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 and response is not null")
    same = cut(same.select(F.col("digest").alias("digest2"), "response"))
    again = narrow.join(same, F.col("digest") == F.col("digest2")).where(~F.col("key").eqNullSafe(F.col("response")))
    again = cut(again.select(F.col("key").alias("key2"), "digest2", "response").distinct())
    named = rows.where(large).join(again, F.col("key").eqNullSafe(F.col("key2")) & (F.col("digest") == F.col("digest2")), "left")
    revisit = F.col("response").isNotNull()
    types = named.select("key", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("response")).alias("refers_to"))
    single = rows.where(~large).select("key", "url", "payload", "digest", F.lit("response").alias("record_type"), F.lit(None).cast(rows.schema["key"].dataType).alias("refers_to"))
    return types.unionByName(single)


def record(key, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_uri(key)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe='%/:=&?~#+!$,;@()*[]' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _uri(key) -> str:
    return "urn:page:none" if key is None else f"urn:page:{quote(str(key), safe='')}"


def archive(records: list[bytes]) -> tuple[bytes, int]:
    """The bytes of an archive and the size of its dictionary."""
    import zstandard

    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    sample = records[::step]
    try:
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, sample)) // 8)), sample, level=LEVEL)
    except zstandard.ZstdError:  # too few records to train on: their beginnings are the dictionary
        dictionary = zstandard.ZstdCompressionDict(b"".join(r[:512] for r in sample[:16]) or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join([pack.compress(r) for r in records]), len(raw)


def write(pages: DataFrame, key: str, url: str, payload: str, least: int = LEAST_SHARED) -> DataFrame:
    """Write one record per page; gives the table of archives, as it is stored in the shared folder.

    A null payload is an empty one, a null url an empty address. Rows that repeat a page are records of their own: those
    with the response's key are responses too. A null key is never the largest; equal payloads without any key are all
    responses. An empty table gives no archives. Other columns are not archived.
    """
    small_batches(pages.sparkSession)
    rows = with_types(pages, key, url, payload, least)
    return stored(rows.mapInArrow(lean(_archives), ARCHIVE), "warc")


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    held: list[bytes] = []
    size = 0

    def close() -> pa.RecordBatch:
        nonlocal held, size, number
        content, n = archive(held)
        out = {"archive_id": ([f"{task:06d}-{number:06d}.warc.zst"], pa.string()), "n_records": ([len(held)], pa.int64()), "dictionary_bytes": ([n], pa.int64()), "content": ([content], pa.binary())}
        held, size, number = [], 0, number + 1
        return batch(out)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(record(*row))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
    if held:
        yield close()


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive: headers (names in lower case) and block."""
    import zstandard

    magic, n = struct.unpack("<II", content[:8])
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary in a skippable frame")
    raw = content[8 : 8 + n]
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    source = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(content[8 + n :]), read_across_frames=True), 1 << 20)
    while line := source.readline():
        if line.rstrip(b"\r\n") != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while line := source.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        block = source.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or source.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield head, block


def read(archives: DataFrame, kind: str = "long") -> DataFrame:
    """archives (content) -> key, url, record_type, refers_to, payload_bytes, payload_digest, payload; keys cast to kind.

    A response's payload is checked against its digest. A revisit's length and digest are those its record states.
    """
    small_batches(archives.sparkSession)
    out = archives.select("content").mapInArrow(lean(_read()), "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out.withColumn("key", F.col("key").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def _read() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import unquote

        def key(uri: str | None) -> str | None:
            return None if uri in (None, "<urn:page:none>") else unquote(uri[len("<urn:page:") : -1])

        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                size = 0
                for head, block in records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if head["warc-type"] == "response" and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    rows.append((key(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], key(head.get("warc-refers-to")), told, digest, payload if head["warc-type"] == "response" else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return batch({n: (list(c), t) for n, c, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})
