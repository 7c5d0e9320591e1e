import hashlib
import struct

import pytest
import zstandard

from kindred.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, key string"


def brute(rows):
    largest = {}
    for k, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and k is not None:
            largest[b] = max(largest.get(b, k), k)
    out = []
    for k, _, html in rows:
        b = (html or "").encode()
        top = largest.get(b) if len(b) >= 1000 else None
        again = top is not None and k != top
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    archives = warc.write(pages, "page_id", "url", "html")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    back = warc.read(archives)
    assert told(back) == brute(rows)
    html = {k: h for k, _, h in rows}
    assert all(r.payload.decode() == html[r.key] for r in back.collect() if r.record_type == "response")
    assert {r.url for r in back.collect()} <= {u for _, u, _ in rows}


def test_edge_cases(spark):
    long = "é<p>" * 400
    rows = [(1, "http://a/ü b", long), (5, None, long), (3, "http://a", long), (3, "http://a", long), (None, "x", long), (7, "y", None), (8, "y", ""), (9, "z", "a" * 999), (2, "z", "a" * 999), (4, "w", "b" * 3_000_000), (6, "w", "b" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    assert told(warc.read(warc.write(pages, "page_id", "url", "html"))) == brute(rows)
    nulls = spark.createDataFrame([(None, "x", long), (None, "x", long)], "page_id long, url string, html string")
    assert [r.record_type for r in warc.read(warc.write(nulls, "page_id", "url", "html")).collect()] == ["response"] * 2
    assert warc.write(pages.limit(0), "page_id", "url", "html").count() == 0


def test_a_common_page_and_keys_that_repeat(spark):
    common = "x" * 1500
    rows = [(i % 90 if i % 7 else None, None, common if i % 3 else "y" * (998 + i % 5)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert told(warc.read(warc.write(pages, "page_id", "url", "html"))) == brute(rows)


def test_format():
    records = [warc.record(i, f"http://e/{i}", f"<html>page {i} {'words ' * (i % 7)}</html>".encode() * 30, hashlib.sha1(b"x").hexdigest(), "response", None) for i in range(300)]
    content, n = warc.archive(records)
    magic, size = struct.unpack("<II", content[:8])
    assert magic == 0x184D2A5D and size == n
    dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + n])
    assert dictionary.dict_id()
    rest, frames = content[8 + n :], 0
    while rest:  # every record is a frame of its own that the dictionary opens
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert one.decompress(rest) == records[frames]
        rest, frames = one.unused_data, frames + 1
    assert frames == len(records)
    assert len(content) < sum(len(zstandard.compress(r, 6)) for r in records)
    assert [h["warc-type"] for h, _ in warc.records(content)] == ["response"] * 300


def test_damage_is_found(spark):
    content, _ = warc.archive([warc.record(1, "u", b"payload" * 300, hashlib.sha1(b"other").hexdigest(), "response", None)])
    archives = spark.createDataFrame([(bytearray(content),)], "content binary")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(archives).collect()
    with pytest.raises(ValueError, match="skippable"):
        list(warc.records(b"\0" * 16))
