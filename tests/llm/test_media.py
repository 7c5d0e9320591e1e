import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kindred.llm import media
from kindred.llm.queries import op6_media


def brute_cuts(data):
    out, last, h = [], 0, 0
    gear = media._GEAR.tolist()
    for i, b in enumerate(data):
        h = (h << 1) + gear[b] & 0xFFFFFFFF
        n = i + 1 - last
        left = len(data) - last
        if left <= media.LEAST:
            break
        if n == media.MOST or (n >= media.LEAST and h >> (32 - media.CUT_BITS) == 0) or i + 1 == len(data):
            out.append(i + 1)
            last = i + 1
    if last < len(data):
        out.append(len(data))
    return out


@pytest.mark.parametrize("n", [0, 1, 512, 513, 576, 5000, 40000])
def test_cuts(n):
    data = random.Random(n).randbytes(n)
    assert media.cuts(data) == brute_cuts(data) if n else media.cuts(data) == [0]
    assert b"".join(media.chunks(data)) == data
    flat = b"a" * n
    assert b"".join(media.chunks(flat)) == flat and max(map(len, media.chunks(flat)), default=0) <= media.MOST


def test_an_insertion_changes_few_chunks():
    data = random.Random(1).randbytes(200_000)
    one, two = set(media.chunks(data)), set(media.chunks(data[:90_000] + b"new words" + data[90_000:]))
    assert len(one - two) <= 4


def want(text):
    raw = (text or "").encode()
    data = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    file = media.wave(data)
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(file), hashlib.sha256(file).hexdigest(), media.features(data)


def told(r):
    return r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op6_media(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert told(r) == want(docs[r.doc_id])


def test_chunks_are_stored_once(spark):
    rng = random.Random(3)
    shared, own = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(9000)) for _ in range(2))
    texts = [shared, shared, shared + own, own + shared, None, "", "x", "long " * 60000, "x"]
    docs = spark.createDataFrame([(i if i != 6 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(3)
    store = media.write(docs, "doc_id", "text")
    stored = [r.digest for r in store.shared.collect()]
    assert len(stored) == len(set(stored)) > 10
    unique = [d for r in store.packs.collect() for d, o in zip(r.digests, r.own, strict=True) if o]
    assert len(unique) == len(set(unique)) and not set(unique) & set(map(bytes, stored))
    rows = media.round_trip(docs, "doc_id", "text").collect()
    assert sorted(told(r) for r in rows) == sorted(want(t) for t in texts)
    assert media.round_trip(docs.limit(0), "doc_id", "text").count() == 0


def test_a_full_filter_costs_no_correctness(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    plain = sorted(map(tuple, media.round_trip(docs, "doc_id", "text").drop("media").collect()))
    import numpy as np

    monkeypatch.setattr(media, "_filter", lambda df: np.full(media.FILTER_BITS // 32, 0xFFFFFFFF, np.uint32))
    assert sorted(map(tuple, media.round_trip(docs, "doc_id", "text").drop("media").collect())) == plain


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some words " * 300)], "doc_id long, text string")
    store = media.write(docs, "doc_id", "text")
    store.packs = store.packs.withColumn("media", F.unhex(F.lit("00" * 16)))
    with pytest.raises(Exception, match="differs"):
        media.read(store).collect()
