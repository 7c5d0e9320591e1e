import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import packing
from kindred.llm.packing import SumOfSquares, WordIds, pack
from kindred.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, ids string, offset int"
PATH = tokenizer_path()


def expected(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]
    return ids


def test_ids_of_odd_words():
    """Words of signs, cases, marks and scripts, alone and in texts, against the tokenizer on whole texts."""
    bits = ["a", "The", "É", "é", "e\u0301", "Σ", "ς", "ΑΣ", "İ", "ß", "ﬁ", "ǅ", "漢字", "ª", "²", "½", "7", "'s", "'", "'LL", "<", ">", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "$$$", ",", ".!", "_", "-", "\\", "…", "’t", "\u0301", "\u200b", "😀", "\xa0", "\x85", "\x1c", "K", "ſ"]
    rng = random.Random(7)
    texts = ["".join(rng.choice([*bits, " ", " ", "\n"]) for _ in range(rng.randint(1, 12))) for _ in range(6000)] + bits + [a + b for a in bits for b in bits]
    words, plain = WordIds(PATH), Tokenizer.from_file(PATH)
    wrong = [t for t, got in zip(texts, words.encode(texts), strict=True) if got != np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()]
    assert wrong == []


def check(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array(expected(text), "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(pack(docs, "doc_id", "text", PATH).collect(), texts)


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "a b\tc\nd\x0be f g", 4: "word " * 9000, 5: "don't <|endoftext|>x Ünïcödé é ΑΣ 12345 The, THE. don.T 7. x,. ,, ǅab ªº ﬁn <|EndOfText|>. <|endoftext|>, É, A.", 6: "a b", 7: "a b", 8: "\x1c \x85 x", 9: "a\x1c!b \u2000 c\u3000d", 10: "e \u0301x q\u0301"}
    docs = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], SCHEMA)
    check(pack(docs, "doc_id", "text", PATH).collect(), texts)
    repeated = pack(docs.union(docs), "doc_id", "text", PATH).collect()
    assert sum(r.length for r in repeated) == 2 * sum(len(expected(t)) for t in texts.values())
    nulls = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    assert [r.doc_id for r in pack(nulls, "doc_id", "text", PATH).collect()] == [None, None]
    assert pack(docs.limit(0), "doc_id", "text", PATH).count() == 0


def test_placement_follows_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer, window = SumOfSquares(64), 64
    for k in range(2000):
        before = packer.count[1:window].copy()
        s = int(rng.integers(1, window))
        levels = [h for h in range(1, window) if before[h - 1] > 0 and h + s <= window]

        def after(h, before=before, s=s):
            c = before.copy()
            if h:
                c[h - 1] -= 1
            if h + s < window:
                c[h + s - 1] += 1
            return (c**2).sum()

        packer.add((k, s), b"\0" * 4 * s)
        assert (packer.count[1:window] ** 2).sum() == pytest.approx(min(after(h) for h in [0, *levels]))
    packer.finish()


def test_a_bound_on_open_windows_keeps_every_token():
    packer, got = SumOfSquares(2048, max_open=8), 0
    for k in range(300):
        packer.add((k, 1), b"\0" * 4 * (700 + 7 * k))
        got += sum(len(p[2]) for w in packer.take() for p in w)
        assert packer.open <= 8
    got += sum(len(p[2]) for w in packer.finish() for p in w)
    assert got == 4 * sum(700 + 7 * k for k in range(300))


def test_beyond_the_bound_the_rule_goes_on():
    """With one window too many only the fullest is closed; the counts of all others stay what they were."""
    rng = np.random.default_rng(5)
    packer = SumOfSquares(64, max_open=12)
    by = defaultdict(int)
    for k in range(3000):
        packer.add((k, 1), b"\0" * 4 * int(rng.integers(20, 64)))
        for w in packer.take():
            assert sum(len(p[2]) for p in w) == 4 * 64
            by[w.by] += 1
        assert packer.open <= 12 and packer.open == sum(map(len, packer.at)) == packer.count[1:64].sum()
        assert all(sum(len(p[2]) for p in w) == 4 * h for h, ws in enumerate(packer.at) for w in ws)
        if k > 100:
            assert packer.open >= 5  # joining all would leave one
    assert by["cut"] > 500 and by["rule"] > 100  # few of these sizes add up to a window, and the rule still closes those


def test_the_rule_closes_most_windows(spark):
    """On the given documents: windows by what closed them."""
    rows = pack(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1), "doc_id", "text", PATH, with_ids=False)
    by = {r.closed_by: r.n for r in rows.groupBy("closed_by").agg(F.countDistinct("sequence_id").alias("n")).collect()}
    assert set(by) <= {"rule", "alone", "cut"} and by["rule"] > by["cut"]


def test_a_worker_makes_room_for_new_words(monkeypatch):
    monkeypatch.setattr(packing, "MAX_WORDS", 300)
    rng, words, plain = random.Random(3), WordIds(PATH), Tokenizer.from_file(PATH)
    usual = [f"usual{i}," for i in range(40)]
    for _ in range(60):
        text = " ".join(usual + ["".join(rng.choice("abcdéXYZ'.") for _ in range(7)) for _ in range(60)])
        assert words.encode([text, "", text[:50]]) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, "", text[:50])]
        assert len(words.at) < 300 + 400
