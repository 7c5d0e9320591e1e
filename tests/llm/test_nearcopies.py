import random

import pytest

import corpus_pipeline
from kindred.llm import bytefeatures
from kindred.llm.bytefeatures import shingle_hashes
from kindred.llm.components import components
from kindred.llm.nearcopies import SIMILARITY, bands, describe, keep_one, least_agreeing, links, shingles, signatures

SF = "/root/testdata/sf0.01"


def brute_sets(docs):
    out = {}
    for k, t in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[k] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_kept(docs):
    """The least key of each group that pairs with a Jaccard similarity of 0.8 or more span."""
    sets = brute_sets(docs)
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k for k in keys if find(k) == k}


def test_shingles():
    words = [f"w{i % 9}" for i in range(40)]
    assert len(shingles(" ".join(words))) == 9 and len(shingles("A b")) == 1 and len(shingles(" \n")) == 0
    assert (shingles("a B\tc  d e f") == shingles("A b c d E F ")).all()


def test_the_stage_finds_every_near_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()} == want


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_of_edited_texts(spark, block):
    """Texts about as far apart as the threshold, in groups larger than a block, with a passage that all share."""
    rng = random.Random(4)
    rows, common = [], [f"c{i}" for i in range(12)]
    for g in range(8):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(15):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(common + words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert 8 < len(want) < 90
    _, nodes = signatures(docs, "doc_id", "text")
    roots = {r.node: r.root for r in components(links(docs, "doc_id", "text", nodes, block=block)).collect()}
    assert len({roots.get(r.id, r.id) for r in nodes.collect()}) == len(want)
    assert {r.doc_id for r in keep_one(docs, "doc_id", "text", block=block).collect()} == want


def test_edge_cases(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, text, "a"), (1, text.upper(), "b"), (2, None, "c"), (4, "", "d"), (5, " ", "e"), (1, text, "b"), (1, other, "h"), (None, text, "f"), (9, "x " * 30000, "g"), (8, "x x", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = keep_one(docs, "doc_id", "text")
    assert kept.columns == docs.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "").lower()[:3]) for r in kept.collect()) == [(-1, "one"), (1, "one"), (1, "sev"), (2, ""), (8, "x x"), (9, "x x")]
    assert keep_one(docs.limit(0), "doc_id", "text").count() == 0


def test_tables_for_the_threshold():
    assert (1 - 0.8**3) ** bands(SIMILARITY) <= 1e-6 < (1 - 0.8**3) ** (bands(SIMILARITY) - 1)
    rng = random.Random(2)
    n = 3 * bands(SIMILARITY)
    met, agreeing = 0, []
    for g in range(150):  # pairs of sets of 90 shingles, 80 of them in common
        base = [f"g{g}w{i}" for i in range(94)]
        other = base[:47] + [f"x{rng.random()}", f"x{rng.random()}"] + base[47:]
        a, b = (frozenset(shingles(" ".join(t)).tolist()) for t in (base, other))
        assert len(a & b) / len(a | b) > 0.8
        _, _, sketch, keys = describe([" ".join(base), " ".join(other)], bands(SIMILARITY))
        met += bool((keys[0, 15:] == keys[1, 15:]).any())
        agreeing.append((sketch[0] == sketch[1]).mean())
    assert met == 150 and min(agreeing) * n > least_agreeing(SIMILARITY, n)
    assert abs(sum(agreeing) / 150 - len(a & b) / len(a | b)) < 0.02


def test_fingerprint_and_one_long_text():
    """A text hashed in many pieces has the signature of the same text in one; 3 equal shingles of 4 decide each bit."""
    text = " ".join(f"word{i % 977}" for i in range(400_000))
    whole = describe([text, "a b"], 20)
    old = bytefeatures._PIECE
    pieces = bytefeatures.pieces
    try:
        bytefeatures.pieces = lambda x: pieces(x, 5000)
        cut = describe([text, "a b"], 20)
    finally:
        bytefeatures.pieces = pieces
    assert old == bytefeatures._PIECE and all((x == y).all() for x, y in zip(whole, cut, strict=True))
    assert whole[0].tolist() == [977, 1]
    h = shingle_hashes(["a a a a a a a b c"], 5)[0]
    want = sum(1 << i for i in range(64) if 2 * sum(int(x) >> i & 1 for x in h) > len(h))
    assert int(describe(["a a a a a a a b c"], 20)[1].view("u8")[0]) == want


def test_texts_that_meet_but_are_not_alike(spark):
    """A passage that all texts share brings them together; none is like another, and none is lost."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert keep_one(docs, "doc_id", "text").count() == 120 == len(brute_kept(rows))
