import random

import numpy as np
import pytest
import xxhash

from kindred.llm.components import components
from kindred.llm.simhash import fingerprint, keep_one, links, masks, near_duplicates


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, keys):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return {k: least[find(i)] for i, k in enumerate(keys)}


def test_masks_cover_the_radius():
    rng, ms = random.Random(1), masks(3)
    assert len(ms) == 15
    for _ in range(3000):
        d = sum(1 << i for i in rng.sample(range(64), 3))
        assert any(m & d == 0 for m in ms)


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "A b C", "a a a a a b", "É x\x0by\x0cz", "w " * 5000])
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    fps = [brute_fingerprint(t or "") for _, t in rows]
    want = brute_components(fps, [k for k, _ in rows])
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in near_duplicates(docs, "doc_id", "text").collect()}
    assert {k: v[1] for k, v in got.items()} == want
    assert [got[k][0] for k, _ in rows] == fps


def test_large_buckets_are_dealt_out(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(links(df, block=16)).collect()}
    want = brute_components([f % 2**64 for f in sorted(signed)], sorted(signed))
    assert {f: got.get(f, f) for f in signed} == want


def test_components_of_a_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    df = spark.createDataFrame([*zip(order, order[1:]), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, n)}
    assert components(df.limit(0)).count() == 0


def test_edge_cases(spark):
    text = "one two three four five six"
    rows = [(3, text, "a"), (1, text, "b"), (2, None, "c"), (4, "", "d"), (5, " ", "e"), (1, text, "b"), (None, text, "f"), (9, "x " * 30000, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = near_duplicates(docs, "doc_id", "text").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component) for r in got) == [(-1, 1), (1, 1), (1, 1), (2, 2), (3, 1), (4, 2), (5, 2), (9, 9)]
    kept = keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 2, 9]
    assert near_duplicates(docs.limit(0), "doc_id", "text").count() == 0 and keep_one(docs.limit(0), "doc_id", "text").count() == 0


def test_a_repeated_key_keeps_its_different_texts(spark):
    """Of key 1 both texts stay, though they lie in different components; copies of each go, under the key and under others."""
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, text), (1, other), (1, text.upper()), (2, other), (0, "thirteen " * 9), (1, "thirteen " * 9), (3, text)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert sorted((r.doc_id, r.text.lower().split()[0]) for r in kept.collect()) == [(0, "thirteen"), (1, "one"), (1, "seven")]
