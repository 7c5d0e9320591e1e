import math
import tracemalloc
import zlib

import numpy as np

from kindred.llm import bytefeatures, langid
from kindred.llm.langid import BUCKETS, UNKNOWN, Model, fit, identify, proportions
from kindred.llm.queries import op10_langid


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op10_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    assert len(own) > 150 and np.mean([r.lang_pred == truth[r.doc_id][0] for r in own]) > 0.97


def test_a_text_of_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs, "text", "lang")
    text = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' and n_chars > 800").orderBy("doc_id").limit(4).collect()) for lang in ("en", "de", "fr")}
    share, _ = proportions([text["en"][:1500] + " " + text["de"][:500], text["fr"][:800], "", text["en"] * 40], model)
    of = {lang: i for i, lang in enumerate(model.languages)}
    assert 0.6 < share[0, of["en"]] < 0.88 and 0.12 < share[0, of["de"]] < 0.4 and share[0, of["es"]] < 0.05
    assert share[1, of["fr"]] > 0.95 and share[2].sum() == 0 and share[3, of["en"]] > 0.9


def test_edge_cases(spark):
    rows = [(1, "the house and the garden of the king", "en", "a"), (2, "der und die und das haus von dem könig", "de", "a"), (3, None, "en", "a"), (4, "", None, "a"), (5, "123 !?", "de", "a"), (6, "the and of", None, "a"), (None, "und das", "de", "a"), (2, "der und die", "de", "a"), (7, "漢字", "de", "a"), (8, "und " * 50000, "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = fit(docs, "text", "lang")
    assert model.languages == ["de", "en"]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.lang_pred, r.score) for r in identify(docs, ["doc_id"], "text", model).collect())
    assert [(k, lang) for k, lang, _ in got] == [(-1, "de"), (1, "en"), (2, "de"), (2, "de"), (3, UNKNOWN), (4, UNKNOWN), (5, UNKNOWN), (6, "en"), (7, "de"), (8, "de")]
    assert all(s == 0 for _, lang, s in got if lang == UNKNOWN)
    none = fit(docs.limit(0), "text", "lang")
    assert {r.lang_pred for r in identify(docs, ["doc_id"], "text", none).collect()} == {UNKNOWN}
    assert identify(docs.limit(0), ["doc_id"], "text", model).count() == 0


def test_counts_cover_all_rows_however_they_lie(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = fit(docs, "text", "lang"), fit(docs.repartition(9), "text", "lang")
    assert one.languages == two.languages and np.array_equal(one.logp, two.logp)


def test_a_text_of_many_languages(spark):
    """Seven languages of letters of their own, all in one text, and fewer in others."""
    own = [[f"{a}{b}{c}" for a in x for b in x for c in x] for x in ("abc", "def", "ghi", "jkl", "mno", "pqr", "stu")]
    rows = [(i, " ".join(words * 20), f"l{i}") for i, words in enumerate(own)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    part = [" ".join(words * 4) for words in own]
    share, _ = proportions([" ".join(part), " ".join(part[:5]), part[3]], model)
    assert ((0.1 < share[0]) & (share[0] < 0.2)).all()
    assert ((0.15 < share[1, :5]) & (share[1, :5] < 0.25)).all() and share[1, 5:].sum() < 0.01 and share[2, 3] > 0.95
    mixed = spark.createDataFrame([(0, " ".join(part))], "doc_id long, text string")
    found = identify(mixed, ["doc_id"], "text", model).collect()[0]
    assert sorted(found.languages) == [f"l{i}" for i in range(7)]


def brute(text, model):
    """Proportions of the languages of one text, step by step in plain Python: groups of four words, EM, BIC."""
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).split()
    groups = [words[i : i + 4] for i in range(0, len(words), 4)]
    k = model.logp.shape[1]
    ll = []
    for g in groups:
        row = [0.0] * k
        for w in g:
            raw = b" " + w.encode() + b" "
            for a, b, c in zip(raw, raw[1:], raw[2:]):
                bucket = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 16
                row = [x + float(y) for x, y in zip(row, model.logp[bucket])]
        ll.append(row)

    def em(allowed):
        pi = [1 / len(allowed) if j in allowed else 0.0 for j in range(k)]
        for _ in range(3000):
            new = [0.0] * k
            for row in ll:
                like = [p * math.exp(max(x - max(row), -60)) for p, x in zip(pi, row)]
                new = [n + x / sum(like) / len(ll) for n, x in zip(new, like)]
            if max(abs(a - b) for a, b in zip(new, pi)) < 1e-9:
                break
            pi = new
        return pi, sum(math.log(sum(p * math.exp(max(x - max(row), -60)) for p, x in zip(pi, row))) + max(row) for row in ll)

    singles = [sum(row[j] for row in ll) for j in range(k)]
    best, score = [float(j == singles.index(max(singles))) for j in range(k)], max(singles)
    order = sorted(range(k), key=lambda j: -em(range(k))[0][j])
    for size in range(2, k + 1):
        pi, total = em(order[:size])
        total -= (0.5 * math.log(len(ll) + 1) + 1) * (size - 1)
        if total <= score:
            break
        best, score = pi, total
    return best


def test_mixtures_against_plain_python(spark):
    """Short and mixed texts, against the same model worked out one trigram at a time."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs, "text", "lang")
    rows = docs.where("n_chars between 30 and 250").orderBy("doc_id").limit(24).collect()
    own = [r.text for r in rows]
    some = own + [f"{a} {b}" for a, b in zip(own, own[7:])] + ["", "x", "7 !", "é É ß", own[0].upper()]
    share, junk = proportions(some, model)
    for text, got, other in zip(some, share, junk):
        want = brute(text, model) if any(c.isalpha() for c in text) else [0.0] * len(got) + [0.0]
        assert np.allclose([*got, other], want, atol=0.02), text


def test_one_text_in_pieces(spark, monkeypatch):
    """However small the pieces are in which likelihoods and bytes are worked through, the result stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit(docs, "text", "lang")
    some = [r.text for r in docs.limit(60).collect()]
    some.append(" ".join(some))
    want = proportions(some, model)
    monkeypatch.setattr(langid, "NUMBERS", 1 << 10)
    cut = bytefeatures.pieces
    monkeypatch.setattr(bytefeatures, "pieces", lambda x: cut(x, 700))
    got = proportions(some, model)
    assert np.allclose(got[0], want[0], atol=1e-6) and np.allclose(got[1], want[1], atol=1e-6)


def test_many_languages_and_a_long_text():
    """A hundred languages and a text of four million characters: arrays stay within a few hundred MB."""
    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.full(BUCKETS, 0.05), 101).T + 1e-7).astype(np.float32)
    text = "some words of a text that is longer than most and that goes on " * (1 << 16)
    tracemalloc.start()
    share, junk = proportions([text], Model([f"l{i}" for i in range(100)], logp))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(share.sum() + junk.sum() - 1) < 1e-6 and peak < 700 << 20


def test_keys_named_like_results(spark):
    docs = spark.createDataFrame([(1, "the house", "en", 0.5), (2, "das haus", "de", 0.7)], "doc_id long, text string, lang string, score double")
    model = fit(docs, "text", "lang")
    got = identify(docs.withColumnRenamed("doc_id", "text_"), ["text_", "score", "lang"], "text", model, keep_text=True)
    assert got.columns == ["text_", "_score", "lang", "lang_pred", "score", "languages", "shares", "text"]
    assert {(r.text_, r._score, r.lang, r.lang_pred, r.text) for r in got.collect()} == {(1, 0.5, "en", "en", "the house"), (2, 0.7, "de", "de", "das haus")}
