import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kindred.llm.mixing import RANGE, STEP, mix, mixed_documents, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, words string"


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    left = total
    while free:
        share = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def brute_taken(rows):
    """rows (key, source, text) -> words taken of each row: goals filled from the source's documents in hash order, again and again."""
    by = defaultdict(list)
    for i, (key, source, text) in enumerate(rows):
        own = ("" if key is None else str(key)) + ":" + hashlib.md5((text or "").encode()).hexdigest()
        by[source].append((hashlib.md5(own.encode()).hexdigest(), -1 if key is None else key, len(words(text)), i))
    target = brute_targets({s: sum(x[2] for x in v) for s, v in by.items()})
    taken = [0] * len(rows)
    for s, v in by.items():
        left = math.floor(target[s] + 0.5)
        v.sort()
        while left > 0 and any(x[2] for x in v):
            for *_, size, i in v:
                taken[i] += min(size, left)
                left -= min(size, left)
    return target, taken


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mix(docs, "doc_id", "text", "source")
    rows = found.documents.collect()
    source = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    target, taken = brute_taken(source)
    want = {k: (s, len(words(x)), t) for (k, s, x), t in zip(source, taken, strict=True)}
    assert {r.key: (r.source, r["size"], r.taken) for r in rows} == want
    assert all(r.target == pytest.approx(target[r.source], rel=1e-12) for r in rows)
    # every prefix of the schedule holds the sources nearly in their shares
    slots = sorted(found.schedule.select("slot", "source").collect())
    total, count = sum(target.values()), defaultdict(int)
    for i, r in enumerate(slots, 1):
        count[r.source] += 1
        if i % 50 == 0:
            assert all(abs(count[s] - i * target[s] / total) < 6 for s in target)
    assert STEP % 2 == 1 and abs(STEP / RANGE - (5**0.5 - 1) / 2) < 1e-8


def test_edge_cases(spark):
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (2, None, "en", "x", None), (3, "", None, "y", 0), (None, "q " * 3000, "en", None, 6000), (4, "é\x0bf g", "en", "y", 5), (5, "one", "de", "z", 3)]
    docs = spark.createDataFrame([(*r, "other", "columns") for r in rows], SCHEMA)
    found = mix(docs, "doc_id", "text", "source", block=4)
    target, taken = brute_taken([(r[0], r[3], r[1]) for r in rows])
    got = found.documents.collect()
    key = lambda k, n, t: (-1 if k is None else k, n, t)
    assert sorted(key(r.key, r["size"], r.taken) for r in got) == sorted(key(r[0], len(words(r[1])), t) for r, t in zip(rows, taken, strict=True))
    assert sum(r.taken for r in got) == pytest.approx(sum(target.values()), abs=3)
    assert mix(docs.limit(0), "doc_id", "text", "source").documents.count() == 0
    empty = docs.where(F.col("doc_id").isin(2, 3))
    assert [r.taken for r in mix(empty, "doc_id", "text", "source").documents.collect()] == [0, 0]
    out = mixed_documents(docs, "doc_id", "text", "source", length="n_chars", block=4)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sum(len(words(r.text)) for r in out.collect()) == sum(taken)
    assert mixed_documents(docs.limit(0), "doc_id", "text", "source").count() == 0


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 500, "é": 70, None: 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in targets(df).collect()} == pytest.approx(brute_targets(sizes))


def test_reruns_and_partitions_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (sorted(map(tuple, mix(d, "doc_id", "text", "source").documents.collect())) for d in (docs, docs.repartition(7)))
    assert one == two


def test_slots_of_documents(spark):
    """first_slot and n_slots against points put on the sources one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mix(docs, "doc_id", "text", "source", block=64)
    targets_ = sorted(((r.source, r.target, r.goal) for r in found.targets.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    need = {s: -(-g // 64) for s, _, g in targets_}
    whole, edge, edges = sum(t for _, t, _ in targets_), 0.0, []
    for s, t, _ in targets_:
        edge += t
        edges.append((s, math.floor(edge / whole * RANGE)))
    n, slots = sum(need.values()), defaultdict(list)
    for i in range(n):
        s = next(s for s, high in edges if i * STEP % RANGE < high)
        if len(slots[s]) < need[s]:
            slots[s].append(i)
    for s in need:
        slots[s] += [n + k for k in range(len(slots[s]), need[s])]
    assert {(r.slot, r.source, r.k) for r in found.schedule.collect()} == {(i, s, k) for s, v in slots.items() for k, i in enumerate(v)}
    first, count = {}, defaultdict(int)
    for r in found.pieces.collect():
        assert r.slot in slots[r.source]
        first[r.key] = min(r.slot, first.get(r.key, r.slot))
        count[r.key] += 1
    assert {r.key: (r.first_slot, r.n_slots) for r in found.documents.collect()} == {r.doc_id: (first.get(r.doc_id), count[r.doc_id]) for r in docs.collect()}


def test_rows_without_a_key(spark):
    """Very many rows without a key, most of them equal, and rows of one key that differ in other columns: all are mixed, none lost."""
    rows = [(None, "a b c d e", "en", "x", i % 2, "", "") for i in range(400)] + [(None, f"t{i} u v", "en", "x", 0, "", "") for i in range(100)] + [(7, "one text", lang, "x", 0, "", "") for lang in ("en", "de", "fr")] + [(8, "z " * 900, "en", "y", 0, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix(docs, "doc_id", "text", "source", block=32).documents.collect()
    target, _ = brute_taken([(r[0], r[3], r[1]) for r in rows])
    assert len(got) == len(rows) and abs(sum(r.taken for r in got) - sum(target.values())) <= 2 and all(r.taken <= 2 * r["size"] for r in got)
    out = mixed_documents(docs, "doc_id", "text", "source", length="n_chars", block=32).collect()
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in got)
    assert {r.lang for r in out if r.doc_id == 7} == {"en", "de", "fr"} and {r.n_chars for r in out if r.text == "a b c d e"} == {0, 1}


def test_files_follow_the_schedule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first = {r.key: r.first_slot for r in mix(docs, "doc_id", "text", "source").documents.collect()}
    for part in mixed_documents(docs, "doc_id", "text", "source").select("doc_id").rdd.glom().collect():
        once = list(dict.fromkeys(r.doc_id for r in part))
        assert [first[k] for k in once] == sorted(first[k] for k in once)
